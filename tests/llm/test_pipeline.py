"""The stages in turn, each held against brute force on what the one before it kept."""

import os
from collections import Counter, defaultdict

import pytest

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline
    from holdfast.llm import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs.collect(), after.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        docs = after
    stages = [kept[n] for n, _ in corpus_pipeline.STAGES]

    before, after = stages[0]
    trees = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    scores = trees.score(np.array([quality.statistics((r.text or "").encode()) for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s >= 0.7)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert not any(labels.get(d) == 1 for d in gone) and any(labels.get(d) == 0 for d in gone)

    before, after = stages[1]
    assert sorted((r.doc_id, r.text) for r in after) == [(d, t) for d, _, _, t in brute.lines([(r.doc_id, r.text) for r in before])]
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = stages[2]
    # Five words and a similarity of 0.8: no two such documents stay, and what goes hangs on one that stays by links of 0.7 or more.
    texts = sorted((r.doc_id, r.text) for r in before)
    ids, near, stay = [d for d, _ in texts], brute.similarities(texts), {r.doc_id for r in after}
    assert not [(ids[a], ids[b]) for (a, b), s in near.items() if s >= 0.8 and ids[a] in stay and ids[b] in stay]
    group = brute.components(len(ids), [p for p, s in near.items() if s >= 0.7], ids)
    assert stay <= set(ids) and all(any(g == h and e in stay for e, h in zip(ids, group, strict=True)) for d, g in zip(ids, group, strict=True) if d not in stay)
    assert set(brute.components(len(ids), [p for p, s in near.items() if s >= 0.7], ids)) <= stay

    before, after = stages[3]
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
        largest[r.source] = max(largest[r.source], len(brute.words(r.text)))
    for r in after:
        taken[r.source] += len(brute.words(r.text))
    target = brute.targets(dict(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in after).values()) <= 2

    before, after = stages[4]
    expected = brute.pieces([(r.doc_id, r.text) for r in before])
    assert brute.check_packing([tuple(r) for r in after], expected) <= sum(e[3] for e in expected) / 1024 * 1.03 + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(tuple(r[:5]) for r in after)


def test_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x " * 5000, None, "a", None), (4, " \n ", "de", None, 3), (5, "a b c d e f", None, "b", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    import tempfile

    folder = tempfile.mkdtemp()
    labels.write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, odd.limit(0), odd.unionAll(odd)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert rows or not n or name.startswith(("quality", "mixing"))
            if "pack" not in name:
                assert out.columns == docs.columns
    # Columns that are named as the operators' own.
    clashing = odd.withColumns({c: odd.doc_id for c in ("doc", "gone", "row", "copies", "score", "fp", "rep", "component_id", "key", "__copy", "__size", "lang.x", "a`b", "two words", "c0")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, folder)
        assert out.columns == clashing.columns or name.startswith("quality")
        assert all(r["copies"] == r["row"] == r.doc_id for r in out.collect())


def test_a_crowd_hides_no_link(spark):
    """A text near one follower of a crowd's leader, in another task than the crowd, and not near the leader."""
    import numpy as np
    from holdfast.llm import wide_simhash as w

    n, most = 102, w.differing(0.8)[1]
    rng = np.random.default_rng(1)
    free = rng.permutation(np.setdiff1d(np.arange(64, w.BITS), w.tables(n, 0.8, 0.99)))
    lead = rng.integers(0, 2, w.BITS, dtype=np.uint8)

    def flipped(bits, places):
        out = bits.copy()
        out[places] ^= 1
        return out

    follower = flipped(lead, free[:120])
    rows = [lead, follower, *(flipped(lead, rng.choice(free, 10, False)) for _ in range(n - 3)), flipped(follower, free[120:240])]
    rows = [(i, np.packbits(r).view(">u8").astype(np.uint64).tobytes()) for i, r in enumerate(rows)]
    assert 120 <= most < 240
    sc = spark.sparkContext
    distinct = spark.createDataFrame(sc.parallelize(rows[:-1], 1).union(sc.parallelize(rows[-1:], 1)), "rep bigint, fp binary")
    assert {r.node: r.component for r in w.groups(distinct, 0.8, 0.99).collect()} == dict.fromkeys(range(1, n), 0)


def test_mixing_writes_no_texts_of_files_again(spark, tmp_path, monkeypatch):
    from holdfast.llm import mixing

    rows = [(None if i % 9 == 0 else i // 2, "w " * (i % 7 + 1), ("a", "b", None)[i % 3], i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, place int").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs, written, plain = spark.read.parquet(f"{tmp_path}/docs"), [], mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, *rest: written.append(df.columns) or plain(df, *rest))
    words = lambda df: sorted((r.source or "", r.doc_id or -1, r.text) for r in df.collect())
    got = words(mixing.mix(docs))
    assert got and not any("text" in columns for columns in written)
    assert got == words(mixing.mix(docs.where("place >= 0"))) and any("text" in columns for columns in written)
