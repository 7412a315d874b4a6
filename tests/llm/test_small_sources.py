"""A mix of large sources and sources of less than some blocks."""

from lumenframe.llm.mixing import mix


def test_small_sources_give_their_targets(spark):
    own = {"a": [400_000] * 100, "b": [300], "c": [1_000, 0], "d": [2_253], "e": [500] * 5, "f": [400_000] * 60 + [17], None: [5]}
    rows = [(k * 1000 + i, s, n) for k, (s, sizes) in enumerate(own.items()) for i, n in enumerate(sizes)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for i, _, n in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in own:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
