"""The quality stage on junk that is spread evenly over hosts, and on a bad host."""

from __future__ import annotations

import corpus_pipeline


def test_junk_goes_at_average_hosts_and_clean_stays(spark):
    clean = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(400)]
    mild = " ".join(f"m{k}" + "$" * (k % 8 == 0) for k in range(40))  # 0.125 symbols a word
    marked = [" ".join(f"s{i}x{k} ###" for k in range(20)) for i in range(20)]
    lined = ["\n".join(f"ok\nok\nl{i}x{k} m{i}x{k} n{i}x{k}" for k in range(20)) for i in range(20)]  # no run of five words twice
    rows = [(i, t, f"h{i % 20}") for i, t in enumerate(clean)]
    rows += [(1000 + i, t, f"h{i}") for i, t in enumerate(marked)] + [(2000 + i, t, f"h{i}") for i, t in enumerate(lined)]
    rows += [(3000, mild, "h0"), (3001, mild, "bad")] + [(4000 + i, t.replace("s", "q"), "bad") for i, t in enumerate(marked * 2)]
    rows += [(5000 + i, t.replace("w", "v"), "bad") for i, t in enumerate(clean[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert got == {i for i in range(400)} | {3000} | {5000 + i for i in range(60)}
