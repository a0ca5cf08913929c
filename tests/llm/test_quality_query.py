"""The registered quality query: its method decides, and no name of a column matters."""

from __future__ import annotations

from barloom.llm.quality import quality_rules
from barloom.llm.queries import queries


def test_the_method_rejects_what_the_base_rules_pass(spark):
    rows = queries()["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    only = [r for r in rows if not r.base_failed and not r.kept]
    assert len(only) > 20 and all(r.n_symbols > 0.1 * r.n_words or r.n_dup_lines > 0 for r in only)
    assert sum(r.kept for r in rows) > 0.8 * len(rows)


def test_working_names_don_t_clash(spark):
    clean = " ".join(f"w{i}" for i in range(30))
    names = "_h string, _t string, _w string, _g int, _p int, _s int, _l int, _lines int, _host string, n int, c0 int, kept string, source string, text string"
    df = spark.createDataFrame([("a", "b", "c", 1, 2, 3, 4, 5, "d", 6, 7, "e", "x", clean), (None,) * 14], names)
    got = quality_rules(df, by_odds=True).collect()
    assert sorted(((r._h, r._lines, r.c0, r.n, r.kept) for r in got), key=str) == [("a", 5, 7, 6, True), (None, None, None, None, False)]
    assert quality_rules(df.filter("false"), by_odds=True).collect() == []
