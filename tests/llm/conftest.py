import random

import pytest

#: Columns whose names the operators use inside, with values that must not matter.
CLASHING = "part int, rank int, length int, h string, row int, norm string, held string, fp int, v int, score double, anchors int, text_ string, n_words int, quality_score double"
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + CLASHING


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(1, 9))) for _ in range(n))


PASSAGE = words(60, 1)


def corpus() -> list[tuple[int | None, str | None]]:
    """Texts with all the cases that an operator must meet."""
    base = words(120, 2)
    near = base.split()
    near[50] = "changed"
    out = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "two words"), (6, "a b c d"),
        (7, base), (8, base), (9, " ".join(near)), (10, "  " + base.replace(" ", "\n") + " "),
        (11, words(30, 3) + " " + PASSAGE + " " + words(40, 4)), (12, PASSAGE + " " + words(50, 5)), (13, words(20, 6) + "\n" + PASSAGE),
        (14, "same " * 80), (15, words(60, 7) + " " + words(60, 7)), (16, "Released under the MIT License.\n" + words(40, 8)),
        (17, "mit license mit license CC-BY 4.0 GNU General Public License apache license"), (18, "Le été déjà vu — ★ 日本語 🙂 " + words(20, 9)),
        (19, "x" * 5000), (20, words(6000, 10)), (21, "line one here\nline one here\n\nline two\nline one here"), (22, "#$% *** | " * 30 + "<tag>"),
        (23, "tab\x0bvertical\x0cfeed\x1cfile\x85next space"), (24, "<|endoftext|> and </s> ▁mark  double  space "), (25, words(35, 11)), (26, words(35, 11) + " tail"),
        (None, words(50, 12)), (None, None), (30, words(45, 13)), (30, words(45, 13)), (31, words(45, 14)), (31, words(44, 15)),
    ]
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", len(t or ""), *([7] * 3), "x", 7, "x", "x", 7, 7, 0.5, 7, "x", 7, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -1")


@pytest.fixture(scope="session")
def tokenizers():
    return pytest.importorskip("public_tokenizers")
