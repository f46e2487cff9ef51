import random

import pytest


def corpus(seed, n=40):
    """Texts with copies, edited copies, runs of one word, empty and null ones, and characters of several bytes."""
    rng = random.Random(seed)
    words = ["ab", "C", "the", "of", "deé", "x,", "日本"] + [f"w{i}" for i in range(rng.choice([2, 30, 300]))]
    docs = []
    for d in range(n):
        kind = rng.random()
        text = docs[rng.randrange(len(docs))][1] or "" if docs else ""
        if docs and kind < 0.25:
            pass
        elif docs and kind < 0.55:
            said = text.split(" ")
            for _ in range(rng.randrange(1, 4)):
                said[rng.randrange(len(said))] = rng.choice(words)
            cut = rng.randrange(len(said) + 1)
            text = " ".join([rng.choice(words) for _ in range(rng.randrange(30))] + said[cut:] + said[:cut])
        elif kind < 0.65:
            text = (rng.choice(words) + rng.choice([" ", "\n", " \t"])) * rng.randrange(200)
        elif kind < 0.7:
            text = None
        elif kind < 0.75:
            text = ""
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(200)))
        docs.append((d * 3 - 9, text))
    rng.shuffle(docs)
    return docs


@pytest.fixture(params=[1, 2, 3])
def docs(request):
    return corpus(request.param)


DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, p bigint, tie string, fp string, n bigint, bucket string"


def frame(spark, docs, schema=DOCUMENT):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "t", "f", 2, "b") for d, t in docs], schema)
