"""The shipped rules, type profiles and fact fields.

Ids, categories, bases, severities, conditions, sources and anchors are fixed values; messages are
our own.
"""

from __future__ import annotations

ICA74 = {"act": "indian_contract_act_1872", "section": "74", "corpus_id": "ica_1872"}
ICA27 = {"act": "indian_contract_act_1872", "section": "27", "corpus_id": "ica_1872"}
MTA11 = {"act": "model_tenancy_act_2021", "section": "11", "corpus_id": "mta_2021"}
RBI = {"act": "rbi_penal_charges_2023", "corpus_id": "rbi_penal_2023"}


def _yes(*fields: str) -> list[dict]:
    return [{f: True} for f in fields]


def _rule(id: str, category: str, basis: str, severity: str, when: dict, message: str, source=None, anchors=(), escalate=None, **more) -> dict:
    out = {"id": id, "category": category, "basis": basis, "severity": severity, "when": when, "message": message}
    if source:
        out |= {"source": source, "anchors": list(anchors)}
    elif basis == "norm":
        out["metric"] = more.pop("metric", category)
    if escalate:
        out["escalate_to_high_when"] = escalate
    return out | more


EMPLOYMENT = [
    _rule("R-EMP-01", "non_compete", "statutory", "medium", {"all": _yes("post_termination_restraint", "restricted_from_competing_or_soliciting")}, "You are restrained after you leave; an agreement in restraint of trade is void to that extent.", ICA27, ["restrained from exercising a lawful profession"], {"any": [{"bond_present": True}, {"garden_leave_days": {"gt": 60}}]}),
    _rule("R-EMP-02", "non_compete", "statutory", "none", {"in_term_restraint_only": True}, "The restraint ends with the employment, and such terms usually hold.", ICA27, ["restrained from exercising a lawful profession"], risky=False),
    _rule("R-EMP-03", "employment_bond", "statutory", "high", {"all": [{"bond_present": True}, {"any": _yes("penalty_amount_stated", "liquidated_damages_stated", "recovery_on_early_exit", "training_cost_clawback")}]}, "A minimum service period is backed by money; only reasonable compensation is due on breach.", ICA74, ["reasonable compensation"]),
    _rule("R-EMP-04", "employment_bond", "statutory", "medium", {"compels_continued_service": True}, "The clause tries to force you to stay; personal service is not specifically enforced.", {"act": "specific_relief_act_1963", "section": "14", "corpus_id": "sra_1963"}, ["specifically enforced"]),
    _rule("R-EMP-05", "ip_assignment", "statutory", "high", {"all": [{"assigns_ip": True}, {"any": _yes("covers_outside_work_hours", "covers_off_premises")}]}, "Work done in your own time or place is assigned too.", {"act": "copyright_act_1957", "section": "19", "corpus_id": "copyright_1957"}, ["assignment of the copyright shall be valid unless it is in writing"]),
    _rule("R-EMP-06", "ip_assignment", "norm", "medium", {"all": [{"assigns_ip": True}, {"any": _yes("covers_outside_work_hours", "covers_off_premises", "assignment_scope_unlimited", "covers_anything_related_to_business")}, {"any": [{"prior_work_carveout": False}, {"prior_work_carveout": {"absent": True}}]}]}, "A wide assignment does not leave out what you made before.", metric="prior_work_carveout_present"),
    _rule("R-EMP-07", "ip_assignment", "statutory", "medium", {"assigns_moral_rights": True}, "Moral rights are assigned, though they stay with the author.", {"act": "copyright_act_1957", "section": "57", "corpus_id": "copyright_1957"}, ["right to claim authorship of the work"]),
    _rule("R-EMP-08", "notice_period", "norm", "medium", {"notice_asymmetric": True}, "The two sides owe different notice.", metric="notice_days_employee_vs_employer"),
    _rule("R-EMP-09", "notice_period", "norm", "low", {"notice_days_employee": {"gt_percentile": 90}}, "Your notice is longer than in most contracts of the corpus.", metric="notice_days_employee"),
    _rule("R-EMP-10", "termination_grounds", "norm", "medium", {"cause_undefined_or_vague": True}, "Cause is so wide that ordinary work could count, and nothing can be put right first.", metric="cause_definition_present"),
    _rule("R-EMP-11", "variable_pay_clawback", "statutory", "medium", {"clawback_on_resignation": True}, "Pay that was earned is taken back because you resign.", ICA74, ["reasonable compensation not exceeding"]),
    _rule("R-EMP-12", "confidentiality", "norm", "low", {"all": [{"perpetual": True}, {"excludes_public_information": False}]}, "Secrecy has no end and covers what is public.", metric="confidentiality_years"),
    _rule("R-EMP-13", "dispute_resolution", "norm", "medium", {"arbitrator_appointed_by_one_side": True}, "Only one side picks the arbitrator.", metric="arbitrator_appointment"),
    _rule("R-EMP-14", "probation_and_confirmation", "norm", "medium", {"probation_extendable_without_limit": True}, "Probation can be prolonged without a limit.", metric="probation_months"),
    _rule("R-EMP-15", "drafting_defect", "norm", "high", {"unfilled_placeholder": True}, "A blank of the template was left open.", escalate={"unfilled_placeholder": True}, metric="unfilled_placeholder"),
    _rule("R-EMP-16", "working_hours", "norm", "high", {"weekly_hours": {"gt": 48}}, "Days and times add up to more than 48 hours a week.", escalate={"weekly_hours_net": {"gt": 48}}, metric="weekly_hours"),
    _rule("R-EMP-17", "exit_terms", "norm", "high", {"settlement_conditional": True}, "Earned money or a certificate is held back on a condition.", escalate={"settlement_conditional": True}, metric="settlement_conditional"),
    _rule("R-EMP-18", "compensation", "norm", "high", {"unpaid_work_period": True}, "Some period of work is unpaid.", escalate={"unpaid_work_period": True}, metric="unpaid_work_period"),
    _rule("R-EMP-19", "incorporated_terms", "norm", "medium", {"material_terms_elsewhere": True}, "A term that matters stands in a paper you were not shown.", metric="material_terms_elsewhere"),
]
RENTAL = [
    _rule("R-RENT-01", "security_deposit", "policy", "high", {"all": [{"any": [{"deposit_months": {"gt": 2}}, {"doc__deposit_months": {"gt": 2}}]}, {"any": [{"premises_type": "residential"}, {"premises_type": {"absent": True}}]}]}, "The deposit is above two months' rent.", MTA11, ["security deposit", "two months"], scope="document"),
    _rule("R-RENT-02", "security_deposit", "policy", "high", {"deposit_months": {"gt": 6}, "premises_type": "non_residential"}, "The deposit is above six months' rent.", MTA11, ["security deposit", "two months"]),
    _rule("R-RENT-03", "security_deposit", "norm", "high", {"forfeiture_at_sole_discretion": True}, "The landlord alone decides whether the deposit comes back.", escalate={"forfeiture_at_sole_discretion": True}, metric="forfeiture_discretion"),
    _rule("R-RENT-04", "lock_in_period", "norm", "medium", {"lock_in_binds_tenant_only": True}, "The lock-in binds the tenant alone.", escalate={"early_exit_forfeits_full_deposit": True}, metric="lock_in_symmetry"),
    _rule("R-RENT-05", "lock_in_period", "statutory", "high", {"early_exit_forfeits_full_deposit": True}, "Leaving early costs the whole deposit, whatever the loss.", ICA74, ["reasonable compensation not exceeding"]),
    _rule("R-RENT-06", "notice_period", "norm", "high", {"notice_asymmetric": True}, "The two sides owe different notice.", escalate={"notice_asymmetric": True}, metric="notice_days_tenant_vs_landlord"),
    _rule("R-RENT-07", "entry_and_inspection", "policy", "high", {"any": [{"entry_without_notice": True}, {"entry_notice_hours": {"lt": 24}}, {"entry_causes_unspecified": True}]}, "The landlord may enter without a day's notice or a stated cause.", {"act": "model_tenancy_act_2021", "section": "17", "corpus_id": "mta_2021"}, ["twenty-four hours", "entry"]),
    _rule("R-RENT-08", "rent_and_escalation", "norm", "medium", {"escalation_percent": {"gt_percentile": 90}}, "The rent rises faster than in most contracts of the corpus.", metric="escalation_percent"),
    _rule("R-RENT-09", "rent_and_escalation", "norm", "medium", {"escalation_undefined": True}, "The rent can change without a formula or a ceiling.", metric="escalation_defined"),
    _rule("R-RENT-10", "registration_and_stamp_duty", "statutory", "medium", {"all": [{"any": [{"term_months": {"gt": 12}}, {"doc__term_months": {"gt": 12}}]}, {"doc__registration_mentioned": False}]}, "A lease of more than a year must be registered, and this one does not say so.", {"act": "registration_act_1908", "section": "17", "corpus_id": "reg_1908"}, ["leases of immovable property from year to year", "for any term exceeding one year"], scope="document"),
    _rule("R-RENT-11", "maintenance_and_repairs", "policy", "medium", {"structural_repairs_on_tenant": True}, "Structural repairs are put on the tenant.", {"act": "model_tenancy_act_2021", "corpus_id": "mta_2021", "query": "landlord responsible structural repairs whitewashing plumbing"}, ["structural repairs"]),
    _rule("R-RENT-12", "termination_and_eviction", "norm", "medium", {"termination_without_cure_period": True}, "A breach ends the tenancy with no time to mend it.", metric="cure_period_days"),
    _rule("R-RENT-13", "renewal_terms", "norm", "medium", {"auto_renews_on_landlord_terms": True}, "It renews by itself on the landlord's terms.", metric="renewal_control"),
    _rule("R-RENT-14", "dispute_resolution", "norm", "medium", {"jurisdiction_away_from_premises": True}, "Disputes are heard away from the premises.", metric="jurisdiction_locality"),
    _rule("R-RENT-15", "security_deposit", "statutory", "high", {"any": _yes("deposit_forfeited_entirely_on_any_breach", "forfeiture_disproportionate_to_breach")}, "Any breach costs the whole deposit; only reasonable compensation is due.", ICA74, ["reasonable compensation"]),
]
LOAN = [
    _rule("R-LOAN-01", "penal_charges", "regulatory", "high", {"penal_interest_added_to_rate": True}, "A late payment raises the rate instead of costing a separate charge.", RBI | {"provision": "penal charges not penal interest"}, ["shall not be levied in the form of penal interest"]),
    _rule("R-LOAN-02", "penal_charges", "regulatory", "high", {"penal_charges_capitalised": True}, "Interest runs on the penalty itself.", RBI | {"provision": "no capitalisation of penal charges"}, ["no capitalisation of penal charges"]),
    _rule("R-LOAN-03", "penal_charges", "regulatory", "high", {"individual_penal_higher_than_corporate": True}, "An individual pays more for the same default than a company.", RBI | {"provision": "individual borrowers penal charges"}, ["shall not be higher than the penal charges applicable to non individual borrowers"]),
    _rule("R-LOAN-04", "disclosure_and_kfs", "regulatory", "medium", {"all": [{"penal_charge_amount_undisclosed": True}, {"any": [{"doc__penal_charge_quantified": False}, {"doc__penal_quantum_withheld": True}]}]}, "Penal charges are named without an amount.", RBI | {"provision": "disclosure in loan agreement and Key Fact Statement"}, ["quantum and reason for penal charges shall be clearly disclosed"]),
    _rule("R-LOAN-05", "default_and_acceleration", "statutory", "high", {"all": [{"stipulated_penalty_amount": True}, {"any": _yes("penalty_disproportionate_to_loss", "penal_charge_amount_undisclosed")}]}, "A fixed sum is due on breach, unknown beforehand or out of proportion.", ICA74, ["reasonable compensation"]),
    _rule("R-LOAN-06", "default_and_acceleration", "norm", "high", {"acceleration_without_notice": True}, "The whole balance can fall due without notice.", escalate={"acceleration_without_notice": True}, metric="cure_period_days"),
    _rule("R-LOAN-07", "interest_rate", "norm", "high", {"rate_reset_at_sole_discretion": True}, "The lender can reset the rate without a benchmark.", escalate={"rate_reset_at_sole_discretion": True}, metric="rate_reset_basis"),
    _rule("R-LOAN-08", "set_off_and_lien", "norm", "medium", {"set_off_across_unrelated_accounts": True}, "Money in your other accounts can be taken for this loan.", escalate={"set_off_without_notice": True}, metric="set_off_scope"),
    _rule("R-LOAN-09", "guarantor_obligations", "norm", "high", {"guarantee_uncapped": True}, "A personal guarantee has no ceiling and no end.", escalate={"guarantee_uncapped": True}, metric="guarantee_cap"),
    _rule("R-LOAN-10", "prepayment_and_foreclosure", "norm", "medium", {"prepayment_penalty": True}, "Paying early costs extra.", metric="prepayment_penalty_percent"),
    _rule("R-LOAN-11", "insurance_bundling", "norm", "medium", {"insurance_mandatory_named_insurer": True}, "Insurance must come from a named company.", metric="insurance_bundled"),
    _rule("R-LOAN-12", "assignment_and_securitisation", "norm", "medium", {"assignment_without_notice": True}, "The loan can pass to others without telling you.", metric="assignment_notice"),
    _rule("R-LOAN-13", "recovery_and_repossession", "norm", "high", {"repossession_without_notice": True}, "The security can be taken without notice.", escalate={"repossession_without_notice": True}, metric="repossession_notice"),
    _rule("R-LOAN-14", "dispute_resolution", "norm", "medium", {"jurisdiction_lender_city_only": True}, "Disputes are heard only where the lender is.", metric="jurisdiction_locality"),
]
RULES = {"employment": EMPLOYMENT, "rental": RENTAL, "loan": LOAN}

#: Short corpus ids and the file stems they stand for, labels and categories of each type (fixed values).
PROFILES = {
    "employment": {
        "slug": "employment", "label": "Employment Offer Letter", "jurisdiction": "IN", "version": 1,
        "corpus": [{"id": "ica_1872", "path": "employment/indian_contract_act_1872.txt"}, {"id": "sra_1963", "path": "employment/specific_relief_act_1963.txt"}, {"id": "copyright_1957", "path": "employment/copyright_act_1957.txt"}],
        "taxonomy": [
            "compensation_structure", "probation_and_confirmation", "notice_period", "employment_bond", "non_compete", "non_solicit", "confidentiality", "ip_assignment",
            "working_hours_and_leave", "termination_grounds", "garden_leave", "variable_pay_clawback", "dispute_resolution", "boilerplate",
        ],
        "severity_scale": ["none", "low", "medium", "high"],
    },
    "rental": {
        "slug": "rental", "label": "Residential Rental Agreement", "jurisdiction": "IN", "version": 1,
        "corpus": [{"id": "mta_2021", "path": "rental/model_tenancy_act_2021.txt"}, {"id": "tpa_1882", "path": "rental/transfer_of_property_act_1882.txt"}, {"id": "reg_1908", "path": "rental/registration_act_1908.txt"}, {"id": "ica_1872", "path": "rental/indian_contract_act_1872.txt"}],
        "taxonomy": [
            "rent_and_escalation", "security_deposit", "lock_in_period", "notice_period", "maintenance_and_repairs", "entry_and_inspection", "subletting_and_guests",
            "use_restrictions", "alterations", "renewal_terms", "termination_and_eviction", "dispute_resolution", "registration_and_stamp_duty", "boilerplate",
        ],
        "severity_scale": ["none", "low", "medium", "high"],
    },
    "loan": {
        "slug": "loan", "label": "Loan Agreement", "jurisdiction": "IN", "version": 1,
        "corpus": [{"id": "ica_1872", "path": "loan/indian_contract_act_1872.txt"}, {"id": "rbi_penal_2023", "path": "loan/rbi_penal_charges_2023.txt"}],
        "taxonomy": [
            "interest_rate", "penal_charges", "prepayment_and_foreclosure", "processing_and_fees", "security_and_collateral", "guarantor_obligations",
            "default_and_acceleration", "recovery_and_repossession", "disclosure_and_kfs", "insurance_bundling", "assignment_and_securitisation", "set_off_and_lien",
            "dispute_resolution", "boilerplate",
        ],
        "severity_scale": ["none", "low", "medium", "high"],
    },
}

#: Fields that are not boolean.
KINDS = {
    "deposit_months": "double",
    "doc__deposit_months": "double",
    "doc__term_months": "double",
    "entry_notice_hours": "double",
    "escalation_percent": "double",
    "garden_leave_days": "double",
    "notice_days_employee": "double",
    "term_months": "double",
    "weekly_hours": "double",
    "weekly_hours_net": "double",
    "premises_type": "string",
}
#: Fields that only the pattern reader may set (fixed values).
READER_ONLY = ("weekly_hours", "weekly_hours_net", "unfilled_placeholder", "settlement_conditional", "unpaid_work_period", "material_terms_elsewhere")
