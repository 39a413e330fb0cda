import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, bucket string, copy int, size string, score double"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows and extra columns with clashing names."""
    rng = random.Random(3)
    base, passage = words(rng, 300), words(rng, 60)
    split = base.split(" ")
    near = " ".join([*split[:100], "other", *split[101:]])
    far = " ".join(w if k % 4 else "changed" for k, w in enumerate(split))
    texts = [
        base, None, "", " \t\n", base, near, far, passage + " " + words(rng, 80), words(rng, 90) + "\n" + passage, words(rng, 3), words(rng, 3), "one", "one", "One",
        words(rng, 20_000), "é" * 150 + " " + "é" * 150, "spam spam " * 120, "x" * 99, "x" * 100, "x" * 101, "naïve Ünïcode. <|im_end|> <|endoftext|> 3.14, …", near,
    ]
    rows = [(k * 7, t, "en", f"s{k % 3}", len(t or ""), k, "b", 1, "s", 0.5) for k, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None, None, None))
    rows.append((28, far + " and more", "en", "s0", 1, 1, "b", 1, "s", 0.5))
    lonely = words(rng, 50)
    rows.append((None, lonely + " end", None, None, None, None, None, None, None, None))
    rows.append((None, lonely, None, None, None, None, None, None, None, None))
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
