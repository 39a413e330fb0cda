"""Queries over whole tables and whole values, by other means than SQL."""

import numpy as np

from parlance import plans
from parlance.operators import planning
from tests.test_oracles import DATA


def test_spread_pool_picks_from_all_vectors(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    want = set()
    for label, pdf in vectors.groupby("label"):
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        x, rng = np.stack(pdf["embedding"].to_numpy()).astype(float), planning.generator(7, "spread", label)
        picks = [int(rng.integers(len(x)))]
        far = np.linalg.norm(x - x[picks[0]], axis=1)
        while len(picks) < min(6, len(x)):
            far[picks] = -1
            picks.append(int(rng.choice(np.argsort(-far, kind="stable")[: min(3, len(x) - len(picks))])))
            far = np.minimum(far, np.linalg.norm(x - x[picks[-1]], axis=1))
        want |= {(label, k, int(pdf["vec_id"][p])) for k, p in enumerate(picks)}
    got = {tuple(r) for r in plans.QUERIES["pool_high"](spark, DATA).collect()}
    assert got == want and any(number >= 400 for _, _, number in got)


def test_csv_parse_keeps_whole_texts(spark, tmp_path):
    odd = ['"', 'a "quoted", b', "line\nbreak\r\nand\rmore", "\n", " spaces ", "\\", 'back\\"slash\\', "", ",", "tab\tüñ ", "x" * 200_000, 'y""', "#", "\n\n\"\n"]
    spark.createDataFrame([(k, x, "s\"0,\n") for k, x in enumerate(odd)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), DATA):
        want = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        got = {r.doc_id: (r.source, r["head"]) for r in plans.QUERIES["csv_parse"](spark, folder).collect()}
        assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {} and len(got) == len(want)
