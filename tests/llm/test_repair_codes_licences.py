"""Structure repair, vector codes and licence scans against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

TURNS = "conv_id bigint, turn bigint, role string, text string, place int, again boolean, fault string, `a.b` string"


def repaired(rows):
    """rows: (turn, role, text) in order. Least (cost, letters) by state, forwards; the repaired lines; faults by row."""
    seen, faults = set(), []
    for _, role, text in rows:
        white = not brute.words(text)
        last = re.sub(f"{brute.WHITE}+$", "", text)[-1:]
        faults.append("blank" if white else "duplicate" if (role, text) in seen else "truncated" if last not in tuple(".!?") else None)
        seen.add((role, text))
    user = {0: 2, 1: 2, 3: 2}
    moves = {"s": {0: 1}, "u": user, "a": {2: 3}}
    forced = {**user, 2: 3}
    name = {2: "user", 3: "assistant"}

    def inserted(best):
        for s in (0, 1, 3, 2):
            if s in best:
                c, a, said = best[s]
                t = forced[s]
                best[t] = min(best.get(t, (10**9,)), (c + 2, a + "I", (*said, f"{name[t]}:")))
        return best

    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(t, *way, new=new):
            new[t] = min(new.get(t, (10**9,)), way)

        for s, (c, a, said) in best.items():
            put(s, c + 3, a + "D", said)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if s in moves.get(role[:1], {}):
                    put(moves[role[:1]][s], c + more, a + "K", (*said, f"{role}:{text}"))
                put(forced[s], c + 2 + more, a + "R", (*said, f"{name[forced[s]]}:{text}"))
        best = inserted(new)
    cost, audit, said = min(best[s] for s in (0, 3) if s in best)
    return cost, audit, "\n".join(said), faults


def summary(conv, rows):
    cost, audit, said, faults = repaired(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def order(r):
    return (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())


def conversations(seed=5, n=120):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for i in range(rng.choice([1, 2, 3, 5, 8, 20])):
            turn = rng.choice([None, i, i, i, i * 2])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "no", "Why? ", "a.b", "", None, " \t", "…", f"text {i}.", f"cut {i}", "x!\x0b", "x.\x85"])
            out.append((conv, turn, role, text, i, False, "f", "c"))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(conversations(), TURNS).repartition(5)


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append((r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " "))
    return {c: sorted(x, key=order) for c, x in out.items()}


def test_repair(spark, turns):
    from holdfast.llm.repair import repair, summaries

    edits = repair(turns)
    assert edits.columns == ["conv_id", "edit", "turn", "was", "fault", "role", "text"]
    got = sorted(map(tuple, summaries(edits).collect()), key=str)
    want = {c: summary(c, x) for c, x in by_conversation(conversations()).items()}
    assert got == sorted(want.values(), key=str)
    assert {x for w in want.values() for x in w[7]} == set("DIKR")
    kept = defaultdict(list)
    for r in edits.where("conv_id = 7 and edit <> 'D'").collect():
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    assert "\n".join(kept[7]) == repaired(by_conversation(conversations())[7])[2]
    assert repair(turns.where("false")).count() == 0 and summaries(repair(turns.where("false"))).count() == 0
    gone = summaries(repair(turns, F.lit(False))).collect()
    assert len(gone) == 121 and {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    far = summaries(repair(spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id bigint, turn bigint, role string, text string"))).first()
    assert far.gaps is None and far.cost == 0


def test_damage_is_found_again(turns):
    from holdfast.llm.repair import damaged, repair, summaries

    want = {c: [] for c in by_conversation(conversations())}
    for conv, turn, role, text, *_ in conversations():
        role, text = role if role is not None else " ", text if text is not None else " "
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            want[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    got = summaries(repair(*damaged(turns))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((summary(c, sorted(x, key=order)) for c, x in want.items()), key=str)


def test_costs_of_states_stay_within_the_band():
    """Every word that rows lead to, from the last on: its last layer holds all states."""
    from holdfast.llm.repair import BAND, Layers, earlier_word, last_word

    seen, new = set(), {last_word()}
    while new:
        seen |= new
        new = {earlier_word(w, i, f)[0] for w in new for i in (" ", "s", "u", "a") for f in range(4)} - seen
    assert all(w >> 4 * BAND & 15 == 15 for w in seen)
    rng, layers, rows = random.Random(1), Layers(), []
    for i in range(3000):
        role = rng.choice(["system", "user", "assistant", "x"])
        rows.append((i, role, "." * (i + 1) if i % 3 else "y" * (i + 1)))
        layers.add(role[:1], 0 if i % 3 else 3)
    cost, audit, _, _ = repaired(rows)
    assert layers.solve() == cost and "".join(x for x, _ in layers.edits()) == audit


def test_a_conversation_arrives_in_batches(spark):
    """Texts pass in several batches; each comes out once, in order."""
    from holdfast.llm.repair import repair

    rows = [(1, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.edit, r.text) for r in out] == [("K", f"{i}.") for i in range(500)]


def coded(vectors, parts=4, entries=256, rounds=4):
    """vectors: (id, integers). Codes by comparing all pairs."""
    n = len(vectors[0][1])
    at = [n * i // parts for i in range(parts + 1)]
    x = np.array([v for _, v in vectors], object).reshape(len(vectors), n)
    seeds = [v for _, v in sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))][:entries]
    books = [[list(s[a:b]) for s in seeds] for a, b in itertools.pairwise(at)]

    def assign():
        found = []
        for p, (a, b) in enumerate(itertools.pairwise(at)):
            found.append([min((sum((int(u) - int(w)) ** 2 for u, w in zip(row[a:b], e, strict=True)), i) for i, e in enumerate(books[p])) for row in x])
        return found

    for _ in range(rounds):
        for p, near in enumerate(assign()):
            for e in range(len(books[p])):
                own = [x[i, at[p] : at[p + 1]] for i, (_, c) in enumerate(near) if c == e]
                if own:
                    books[p][e] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    near = assign()
    return [(vectors[i][0], [near[p][i][1] for p in range(parts)], sum(near[p][i][0] for p in range(parts))) for i in range(len(x))], books


@pytest.mark.parametrize(("length", "entries", "parts"), [(16, 9, 4), (10, 300, 4), (3, 5, 4), (36, 4, 1), (64, 12, 4)])
def test_vector_codes(spark, length, entries, parts):
    from holdfast.llm.vector_codes import compress

    rng = np.random.default_rng(length)
    x = rng.normal(size=(120, length)).astype(np.float32)
    x[20:40] = x[:20]  # ties
    x[50] = 0
    x[60:] *= 100
    rows = [(i if i % 9 else i // 9, v.tolist(), i % 3 or None, "e", 1, "x") for i, v in enumerate(x)]
    rows[5] = (None, *rows[5][1:])
    odd = [(900, None), (901, [1.0] * (length - 1) + [None]), (902, [float("nan")] * length), (903, [float("inf")] * length)]
    held = [(904, [1.0] * (length + 1)), (905, []), (906, [3e38] * length), (907, [-3e38] * length)]
    schema = "vec_id bigint, embedding array<float>, label int, error string, v int, `a.b` string"
    df = spark.createDataFrame(rows + [(*r, 1, "e", 1, "x") for r in odd + held], schema).repartition(3)
    made = compress(df, entries=entries, parts=parts)
    assert made.rows.columns == ["vec_id", "label", "v", "a.b", "code", "error"]
    want, books = coded([(r[0], tuple(int(np.floor(1024 * float(c))) for c in r[1])) for r in rows], parts, entries)
    assert [b.tolist() for b in made.books] == books
    got = [(r.vec_id, r.code, r.error) for r in made.rows.collect()]
    assert sorted(got, key=str) == sorted(want + [(i, None, None) for i, _ in held], key=str)


def test_vector_codes_of_nothing(spark):
    from holdfast.llm.vector_codes import compress

    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert compress(empty).rows.count() == 0 and compress(empty).books == []
    one = compress(spark.createDataFrame([(1, [1.5, -0.0001])], "vec_id bigint, embedding array<double>"))
    assert one.rows.collect()[0].code == [0, 0, 0, 0] and one.books[1].tolist() == [[1536]] and one.books[3].tolist() == [[-1]]


def test_bounds_lose_no_nearest_entry():
    """Large and small components, entries that differ in a single place, and all-equal parts."""
    from holdfast.llm.vector_codes import Book

    rng = np.random.default_rng(4)
    for high, width in ((3, 16), (2000, 16), (1 << 29, 4), (190_000_000, 16), (5, 7)):
        entries = rng.integers(-high, high + 1, (60, width))
        entries[1], entries[3] = entries[0], high - 1
        rows = np.concatenate([rng.integers(-high, high + 1, (700, width)), entries, entries + np.eye(1, width, 2, dtype=np.int64)])
        far = ((rows[:, None, :] - entries) ** 2).sum(axis=2)
        code, error = Book(entries).nearest(rows)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


LICENCE_DOCS = [
    "Released under the MIT License.", "mit\nLICENSE mit-license MITLICENSE mit  _license", None, "", "é mit licenseé mit license", "apache license general public license apache License",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "license mit apache public general",
    "word " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without any limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of our Software" + " word" * 300,
    "mit license " * 40, "x" * 5000 + " mit license", "permission is hereby granted free of charge", "the of to and in any under license software", "\x7fmit\x00license\x1f mit\u0085license mit　license",
]


def base_by_hand(text):
    from holdfast.llm.license_scan import PHRASES

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(text or ""))
    hits = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(hits)


@pytest.mark.parametrize("chunk", [1 << 20, 16])
def test_licence_scan(spark, chunk):
    from holdfast.llm import license_scan

    more = [(i, t) for i, t in enumerate(LICENCE_DOCS)]
    rng = random.Random(2)
    few = ["mit", "license", "apache", "general", "public", "x", "licensed", "under", "the", "version", "2", "0", "gnu"]
    more += [(100 + i, rng.choice([" ", "\n", ".", " - "]).join(rng.choice(few) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    more += [(None, "mit license"), (0, LICENCE_DOCS[0])]
    df = spark.createDataFrame([(d, t, "own", 3, "z") for d, t in more], "doc_id bigint, text string, licences string, c0 int, `a.b` string").repartition(3)
    index = license_scan.Index.of(license_scan.PHRASES, license_scan.TEMPLATES)
    out = license_scan.scan(df)
    assert out.columns == ["doc_id", "text", "c0", "a.b", "n_words", "licences"]
    rows = out.collect()
    assert sorted(str((r.doc_id, r.n_words, sorted((m.start, m.label) for m in r.licences if m.base))) for r in rows) == sorted(str((d, *base_by_hand(t))) for d, t in more)
    labels = {r.doc_id: {m.label for m in r.licences if not m.base} for r in rows}
    assert labels[0] == {"mit-notice"} and labels[6] == {"apache-2.0"} and labels[7] == {"gpl-3.0"} and labels[8] == {"cc-by-nc-4.0"}
    assert labels[10] == {"mit-text"} and not labels[9] and not labels[13] and not labels[14]
    (match,) = [m for r in rows if r.doc_id == 10 for m in r.licences]
    assert match.start == 500 and 0.75 <= match.share < 1 and all(m.share == 1 for r in rows for m in r.licences if m.base)
    assert license_scan.scan(df.where("false")).count() == 0
    # Texts split in small parts give the same words and places.
    license_scan.CHUNK, before = chunk, license_scan.CHUNK
    try:
        for r in rows:
            assert index.places((r.text or "").encode())[0] == r.n_words
    finally:
        license_scan.CHUNK = before


def test_weights_count_documents(spark):
    from math import log

    from holdfast.llm import license_scan

    index = license_scan.Index.of({"mit license": "mit"}, {})
    found = license_scan.weighed(spark.createDataFrame([("mit mit x",), ("license",), ("mit license",), (None,)], "text string").repartition(2), index)
    assert found.weight == [log(1 + 5 / 3), log(1 + 5 / 3)]
    with pytest.raises(ValueError, match="mandatory"):
        license_scan.Index.of({}, {"a": ("some words", ["other"])})
