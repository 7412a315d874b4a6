"""The divergence half of the quality rules against plain Python, on made-up prose and junk."""

import re

import numpy as np
from lumenframe.llm import quality_rules


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def prose(n, seed, rate=0.3):
    """n made-up words, a share of them common English ones."""
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(quality_rules.COMMON["en"]) if rnd.random() < rate else "".join(rnd.choice(list("etaoinshrdlu"), rnd.integers(3, 9))) for _ in range(n))


def test_all_common_words_are_counted(spark):
    texts = [prose(150, i) for i in range(20)] + [None, "from für par con from", "it's " + " ".join(quality_rules.WORDS * 2)]
    # characters at a distance of 0.28 to 0.33 from the others'
    texts.append(" ".join(w + "%" * (k % 5 < 2) * 3 for k, w in enumerate(prose(150, 99).split())))
    d = spark.createDataFrame([(i, t, "en" if i < 20 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert {"from", "für", "par", "con", "with", "au"} <= set(quality_rules.WORDS)
    for i, t in enumerate(texts):
        w = words(t)
        counts = [w.count(x) for x in quality_rules.WORDS]
        assert got[i]["word_bins"] == [*counts, len(w) - sum(counts)]
    assert 0.28 < got[23]["char_distance"] < 0.33 and not got[23]["base_failed"] and not got[23]["kept"]
    assert all(got[i]["kept"] for i in range(20))


def test_texts_without_common_words_go(spark):
    texts = [prose(150, i, 0.15 + 0.01 * i) for i in range(20)] + [prose(300, 50, 0), " | ".join(prose(300, 51, 0).split()), prose(30, 52, 0), None]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert not any(got[i]["base_failed"] for i in range(23))
    assert {i for i, r in got.items() if r["kept"]} == {*range(20), 22}
    # where no text has common words there is nothing to hold texts against
    assert all(r["kept"] for r in quality_rules.judge(d.where("doc_id in (20, 22)")).collect())


def divergence(bins, references):
    """The least Jensen-Shannon distance to base 2 of counts from reference counts."""
    out = []
    for r in references:
        p, q = np.array(bins) / max(1, sum(bins)), np.array(r) / max(1, sum(r))
        m = (p + q) / 2
        kl = lambda x, m=m: sum(a * np.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        out.append(max(0.0, (kl(p) + kl(q)) / 2) ** 0.5)
    return min(out)


def test_counts_and_distances(spark):
    texts = [prose(60 + 10 * i, i) for i in range(12)] + ["#tag $5 *bold* a|b <x> & 100% " * 9, "| ".join(prose(90, 77).split()), "A1 B2, C3!\n" * 30, "", None, "日本 É ñ \u00a0 x\u0301 Ⅷ ½ _ ="]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    import regex

    order = (r"\p{Ll}", r"\p{Lu}", r"[\p{L}\p{M}]", r"\p{N}", r"[\s\p{Z}]", r"[.,;:!?'\"()\-]")
    for i, t in enumerate(texts):
        bins = [0] * 7
        for c in t or "":
            bins[next((k for k, p in enumerate(order) if regex.fullmatch(p, c, regex.ASCII if k == 4 and c in "\x85" else 0)), 6)] += 1
        assert got[i]["char_bins"] == bins
        assert got[i]["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i]["word_chars"] == sum(map(len, words(t)))
    ok = [r for r in got.values() if not r["base_failed"] and r["n_words"] >= quality_rules.LEAST_WORDS]
    chars, common = (np.sum([r[c] for r in ok], axis=0) for c in ("char_bins", "word_bins"))
    none = divergence([0] * len(quality_rules.WORDS) + [1], [common])
    for r in got.values():
        if r["n_words"]:
            assert abs(r["char_distance"] - divergence(r["char_bins"], [chars])) < 1e-9
            assert abs(r["word_distance"] - divergence(r["word_bins"], [common])) < 1e-9
        far = sum(r["char_bins"]) >= 200 and r["char_distance"] > 0.28 or r["n_words"] >= 40 and r["word_distance"] > 0.95 * none
        assert r["kept"] == (not r["base_failed"] and not far)
    assert {r["kept"] for r in ok} == {True, False}


def test_languages_without_a_reference_are_left_alone(spark):
    rows = [(i, prose(150, i), "en") for i in range(10)] + [(10, prose(300, 50, 0), "it"), (11, prose(300, 50, 0), None), (12, "語の文章 " * 90, "ja"), (13, "語" * 3 + " x", "ja")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame([(i, t if i != 12 else " ".join(f"語{k}文章の" for k in range(90)), g) for i, t, g in rows], "doc_id long, text string, lang string")).collect()}
    assert {i for i, k in got.items() if not k} == {11, 13}


def test_query(spark, tmp_path):
    """The query's own columns against plain Python, and its verdict against that of the operator."""
    passage = " ".join(f"w{k}" for k in range(30))
    texts = [prose(60 + 10 * i, i) for i in range(10)] + ["", None, " \t\n", "a b\na b\n\nc", "\n".join([prose(12, 5)] * 9), f"{passage} x {passage}", "#tag $5 100% <x> & a|b*" * 40, "one two\x0bthree\x0cfour\rfive"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.op4_divergence_rules(spark, str(tmp_path)).collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        repeated = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed)
        assert got[i]["kept"] == verdict[i] and not (failed and got[i]["kept"])
