import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "Alpha beta Gamma delta epsilon zeta eta theta iota Kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and blank texts, one word, copies, near copies, ties, repeated rows, other scripts, a very long text."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    near = []
    for k in range(6):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        near.append(" ".join(w))
    texts = [None, "", " \n\t ", "one", "ONE", "One two", base, base.upper(), base, *near, "école été ÀÉ", "ecole", "漢字 かな 한국어", "<|endoftext|> a <|startoftext|>", "İ Σ ΑΣ ſ", "a\x0bb\x1cc d",
             "x" * 4000, sentence(rng, 6000), " ".join(["same"] * 3000), *(sentence(rng, rng.randrange(1, 300)) for _ in range(25))]
    out = [(i, t, rng.choice(["en", "de", None]), None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], out[4]]  # two rows occur twice


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those of results and intermediates."""
    clash = "id key text_sha256 keep_id kept component_id digest sig n h bucket ahead place tail terms spans score a b".split()
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return df.selectExpr("*", *(f"'clash' AS {c}" for c in clash))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
