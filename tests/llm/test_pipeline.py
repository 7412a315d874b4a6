"""The stages of corpus_pipeline, each on all its predecessor kept, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from lumenframe.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = corpus_pipeline.COLUMNS


def documents():
    """Clean prose, exact and near copies, a shared passage, and what the rules reject."""
    rnd = random.Random(8)
    common = "the of and to in is that it was for on with as at by from this be are have".split()
    prose = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    texts = [prose(rnd.randint(120, 200)) for _ in range(24)]
    near = texts[3].split()
    near[60] = "changed"
    passage = prose(70)
    texts += [texts[3], " ".join(near), texts[5], f"{prose(90)} {passage} {prose(40)}", f"{prose(60)} {passage}", passage]
    texts += [None, "", "too short", "again and again the same line\n" * 30, " \t\n"]
    return [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")


def fails_base(text):
    w = words(text)
    seen = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = Counter(seen)
    cover = {k + j for k, x in enumerate(seen) if count[x] > 1 for j in range(8)}
    return len(w) < 20 or 100 * len(cover) > 30 * len(w)


def first_of_classes(rows):
    """Ids of the smallest document of each class at a Jaccard similarity of 0.8 over five-word shingles."""
    sets = {r["doc_id"]: {tuple(words(r["text"])[k : k + 5]) for k in range(max(len(words(r["text"])) - 4, 0))} for r in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def without_repeats(rows):
    """Words left by document; documents of which nothing is left are not there."""
    out, first = {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        gone = {k + j for k in range(len(w) - 49) if first.setdefault(tuple(w[k : k + 50]), r["doc_id"]) < r["doc_id"] for j in range(50)}
        if len(gone) < len(w) or not w:
            out[r["doc_id"]] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    docs, out = spark.read.parquet(f"{where}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(where)).write.parquet(f"{where}/{i}")
        docs = spark.read.parquet(f"{where}/{i}")
        out.append(docs.collect())
    return str(where), out


def test_stages_are_in_order(chain):
    _, out = chain
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "substring dedup", "mixing", "byte BPE"]
    assert all(list(rows[0].asDict()) == COLUMNS for rows in out[1:-1])


def test_quality(chain):
    before, after = chain[1][0], chain[1][1]
    assert {(r["doc_id"], r["text"]) for r in after} == {(r["doc_id"], r["text"]) for r in before if not fails_base(r["text"])}


def test_near_dedup(chain):
    before, after = chain[1][1], chain[1][2]
    assert {r["doc_id"] for r in after} == first_of_classes(before)
    assert {24, 25, 26}.isdisjoint(r["doc_id"] for r in after)


def test_substring_dedup(chain):
    before, after = chain[1][2], chain[1][3]
    assert {r["doc_id"]: words(r["text"]) for r in after} == without_repeats(before)
    assert sum(map(len, without_repeats(before).values())) < sum(len(words(r["text"])) for r in before)


def test_mixture(chain):
    before, after = chain[1][3], chain[1][4]
    texts, uses = {r["doc_id"]: tuple(r) for r in before}, Counter(r["doc_id"] for r in after)
    assert all(tuple(r) == texts[r["doc_id"]] for r in after)
    assert max(uses.values()) <= 2
    # targets: shares of 5, 2, 1 of one and a half times all words, at most twice a source's own
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    weight = dict(zip(("a", "b", None), (5, 2, 1), strict=True))
    left, target, free = 1.5 * sum(size.values()), {}, set(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        for s in over or free:
            target[s] = min(share[s], 2 * size[s])
            left -= target[s]
        free -= over or free
    for s, want in target.items():
        # whole documents, so a source is off by less than one of its documents on either side
        most = max(len(words(r["text"])) for r in before if r["source"] == s)
        assert abs(sum(len(words(r["text"])) for r in after if r["source"] == s) - want) <= 2 * most


def test_tokens(chain):
    before, after = chain[1][4], chain[1][5]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    want = sorted((r["doc_id"], known.encode_ordinary(r["text"])) for r in before)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in after) == want


def test_run_gives_the_same_rows(spark, chain):
    where, out = chain
    key = lambda r: (r["doc_id"], bytes(r["ids"]))
    assert sorted(map(key, corpus_pipeline.run(spark, where).collect())) == sorted(map(key, out[5]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
