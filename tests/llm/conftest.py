import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, node long, _key string, tile long"


@pytest.fixture(scope="session")
def nasty():
    """Rows with nulls, empty and long texts, ties and repeats; columns whose names helpers might use."""
    r = random.Random(4)
    vocab = ["alpha", "Beta", "gamma,", "delta.", "épée", "z z", "12", "the", "of", "und"] + [f"w{i}" for i in range(200)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(60), say(40)
    words = base.split(" ")
    texts = [None, "", "", " \n\t ", "one", "one two three", "one two three", "ONE two three", base, base, base.upper(), base + " tail", " ".join(words[:58]), " ".join(["x", *words[1:]])]
    texts += [say(30) + "\n" + passage + " " + say(r.randint(0, 30)) for _ in range(12)] + [passage, passage + " " + passage, "a a " * 40, say(6000), "nospace" * 3000, say(25) + "  " + say(3) + "   " + say(2), "　 <|endoftext|> x"]
    rows = [(i, t, "en", "s", len(t or ""), "r", 5, "k", 9) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[8], rows[4]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, nasty):
    return spark.createDataFrame(nasty, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def unique(spark, nasty):
    """The same without null and repeated ids."""
    seen = {r[0]: r for r in nasty if r[0] is not None}
    return spark.createDataFrame(list(seen.values()), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
