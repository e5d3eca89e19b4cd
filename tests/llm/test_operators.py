"""Each operator against brute force, on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, exact_dedup, jaccard_join, language_id, mixing, packing, pii, quality_model, quality_rules, toxicity
from tesserae.llm.queries import tokenizer_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, bucket int, size int"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards quietly box nine more heavy jugs of liquor near old stone bridge at dawn".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + ("" if x % 5 else str(x % 97)) + ("." if i % 11 == 10 else ""))
    return " ".join(out)


TEXTS = [
    (1, prose(1, 80), "en", "a"),
    (2, prose(1, 80), "en", "a"),
    (3, prose(1, 80).upper(), "en", "b"),
    (4, prose(1, 78) + " changed ending", "en", "b"),
    (5, prose(2, 60), "en", None),
    (6, None, None, None),
    (7, "", "en", "a"),
    (8, " \n\t ", "en", "a"),
    (9, "Only four words here", "en", "c"),
    (10, "only FOUR words here", "en", "c"),
    (11, prose(3, 5000), "en", "c"),
    (12, "dup line\nother\ndup line\n  \n  \n### $$$ %%% a|b <c>", "en", "d"),
    (13, "été à la plage, où ça? 中文 😀 <|endoftext|> don't we'll\n\n  x", "fr", "d"),
    (14, " ".join(["one two three four five six seven eight nine"] * 4), "en", "d"),
    (14, " ".join(["one two three four five six seven eight nine"] * 4), "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 1, 2) for i, t, lang, s in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (3, 5, 9))) for i in range(1, 15)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(docs, empty):
    got = sorted(tuple(r) for r in exact_dedup.exact_classes(docs, salts=4).collect())
    groups = defaultdict(list)
    for i, t, _, _ in TEXTS:
        groups[(t or "").translate(LOWER)].append(i)
    want = sorted((i, max(g), len(g), i == max(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g)
    assert got == want
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({max(g) for g in groups.values()})
    assert exact_dedup.exact_classes(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_classes(docs, salts=65)


def test_exact_dedup_of_one_id_keeps_a_defined_row(spark):
    rows = [(7, "Same Text", "en", "a", 1), (7, "same text", "fr", "b", 2), (7, "SAME TEXT", "de", "c", 3), (3, "same text", "en", "d", 4), (9, "alone", "en", "e", 5)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert sorted(tuple(r) for r in exact_dedup.exact_dedup(df).collect()) == [rows[2], rows[4]]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark, docs, empty):
    want = brute_components(TEXTS)
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_join_chains_and_hubs(spark):
    """Chains of near copies whose ends differ, and a group with one centre: links through others count."""
    rows, base = [], prose(9, 60).split()
    for k in range(12):  # a chain: each differs from the one before in one word
        base = [*base[: 4 * k], f"w{k}", *base[4 * k + 1 :]]
        rows.append((100 + k, " ".join(base)))
    centre = prose(10, 80).split()
    rows += [(200 + k, " ".join([*centre[: 5 * k], f"z{k}", f"y{k}", *centre[5 * k + 2 :]])) for k in range(15)] + [(250, " ".join(centre))]
    rows += [(300 + k, prose(20 + k, 40) + " " + " ".join(centre[:20])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_repeated_and_missing_ids(spark):
    """Texts that share an id are apart; rows without an id are whole rows of every operator's result."""
    rows = [(1, prose(1, 50)), (5, prose(2, 50)), (5, prose(1, 50) + " x"), (None, prose(1, 50)), (None, prose(7, 50)), (None, None), (5, prose(2, 50))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (5, 5), (5, 5), (5, 1), (None, None), (None, None), (None, None)], key=str)
    kept = jaccard_join.deduplicated(df).collect()
    assert sorted(((r["doc_id"], (r["text"] or "")[-9:]) for r in kept), key=str) == sorted([(i, (t or "")[-9:]) for k, (i, t) in enumerate(rows) if k != 2], key=str)
    kept = exact_dedup.exact_dedup(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5]], key=str)
    assert packing.pack(df, *tokenizer_files()).where("doc_id is null").count() == 3
    assert quality_rules.quality_rules(df).where("doc_id is null").count() == 3
    assert mixing.mix(df).where("doc_id is null").count() == 3
    assert pii.pseudonymised(df, key="k").where("doc_id is null").count() == 3
    assert language_id.language_id(df).where("doc_id is null and not held_out").count() == 3
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(df, labels).where("doc_id is null and not held_out").count() == 3
    assert quality_model.quality_scores(df, labels).where("doc_id is null and not held_out").count() == 3


def test_lists_keep_postings_with_a_fitting_size():
    """A list over many batches loses no row that a set of fitting size shares, and keeps no other unless it is spread."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [(1, 3, 7, 0), (9, 4, 7, 0), (9, 5, 10, 0), (12, 7, 30, 0), (12, 8, 40, 0), (13, 1, 9, 4)]
    rows += [(5, i, int(2 ** rng.uniform(0, 24)), 0) for i in range(3000)] + [(20 + i % 40, i, int(rng.integers(1, 60)), 0) for i in range(2000)]
    want = {(t, s) for t, s, n, salt in rows if salt or any(t == u and s != v and 4 * min(n, m) >= 3 * max(n, m) for u, v, m, _ in rows)}
    rows = sorted([(t, n << 32, s, salt) for t, s, n, salt in rows + rows[::3]])
    cols = [np.array(x, np.int32 if k == 3 else np.int64) for k, x in enumerate(zip(*[(t, s, p, salt) for t, p, s, salt in rows], strict=True))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in cols], ["token", "set", "place", "salt"]) for i in range(0, len(rows), 7)]
    out = [r for b in jaccard_join._shared(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(out) == len(set(out)) and set(out) == want


@pytest.mark.parametrize("extra", [3, 10])
def test_linked_sets_share_enough_postings(extra, monkeypatch):
    monkeypatch.setattr(jaccard_join, "EXTRA", extra)
    for n in range(1, 400):
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            common = -(-3 * (n + m) // 7)
            if common <= min(n, m):
                assert min(common - k + jaccard_join.prefix(k) for k in (n, m)) >= 1 + n // extra


def test_jaccard_join_whole_table(spark):
    """Brute force over every document of a table, with lists spread over tasks and without."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_components([(r["doc_id"], r["text"]) for r in rows.collect()])
    for long in (jaccard_join.LONG, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(jaccard_join, "LONG", long)
            got = jaccard_join.near_duplicates(rows).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_hub_rounds_end_when_they_save_nothing(spark, monkeypatch):
    """Unlike documents made of shared passages: no hub answers for another, so a third round would be idle."""
    passages = [prose(50 + k, 10) for k in range(12)]
    rows = [(i, " ".join(passages[k] for k in chosen)) for i, chosen in enumerate(list(itertools.combinations(range(12), 6))[::7])]
    rows += [(1000 + i, t) for i, t in rows[:5]]
    turns, pairs = [], jaccard_join._hub_pairs
    monkeypatch.setattr(jaccard_join, "_hub_pairs", lambda lists, compared, turn: turns.append(turn) or pairs(lists, compared, turn))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert turns == [0, 1]
    assert got == brute_components(rows)


def test_components_of_few_edges_take_few_tables(spark, monkeypatch):
    """A chain, a star and a ring: few edges are joined by one task, many in rounds, with equal results."""
    rng = np.random.default_rng(3)
    name = rng.permutation(400)
    edges = [(k, k + 1) for k in range(100)] + [(150, k) for k in range(151, 250)] + [(300 + k, 300 + (k + 1) % 50) for k in range(50)] + [(390, 390)]
    edges = [(int(name[a]), int(name[b])) for a, b in edges]
    want = {int(name[k]): int(name[lo:hi].min()) for lo, hi in ((0, 101), (150, 250), (300, 350)) for k in range(lo, hi)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3).cache()
    puts, put = [], jaccard_join.Scratch.put
    monkeypatch.setattr(jaccard_join.Scratch, "put", lambda self, rows, name: puts.append(name) or put(self, rows, name))
    got = jaccard_join.components(df, jaccard_join.Scratch(spark, "test")).collect()
    assert {r["id"]: r["comp"] for r in got} == want and len(got) == len(want)
    assert len(puts) == 2
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    got = jaccard_join.components(df, jaccard_join.Scratch(spark, "test")).collect()
    assert {r["id"]: r["comp"] for r in got} == want and len(got) == len(want)


def test_edges_are_joined_in_pieces():
    import pyarrow as pa

    edges = np.random.default_rng(4).integers(0, 60, (2, 40))
    batches = [pa.RecordBatch.from_arrays([pa.array(e) for e in edges[:, i : i + 5]], ["a", "b"]) for i in range(0, 40, 5)]
    whole = lambda rows: sorted((r["a"], r["b"]) for b in rows for r in b.to_pylist())
    assert whole(jaccard_join._joined(jaccard_join._joined(iter(batches), 10))) == whole(jaccard_join._joined(iter(batches)))


def test_quality_counts(docs, empty):
    def brute(t):
        t, w = t or "", words(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    got = quality_rules.quality_rules(docs).collect()
    assert sorted((r["doc_id"], *r[1:7]) for r in got) == sorted((i, *brute(t)) for i, t, *_ in TEXTS)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} >= {1, 5, 11}
    assert quality_rules.quality_rules(empty).count() == 0


def test_divergence():
    import numpy as np

    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality_rules.divergence(p, np.array([0.0, 1.0]))[0] == pytest.approx(1.0)
    assert quality_rules.divergence(p, np.array([0.5, 0.5]))[1] == pytest.approx(0.0)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_files()[0])
    got = packing.pack(docs, *tokenizer_files(), size=64, grain=4).collect()
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in TEXTS}
    pieces, place = defaultdict(list), defaultdict(list)
    for r in got:
        chunk = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(chunk) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in chunk)) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        place[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in Counter(i for i, *_ in TEXTS).items():
        assert sum(k for _, k in pieces[i]) == n * len(ids[i])
    for spots in place.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(place) == list(range(len(place)))
    assert packing.pack(empty, *tokenizer_files()).count() == 0


@pytest.mark.parametrize("demand", [{1: 5}, {128: 3, 64: 1}, {k: (k * 37) % 50 + 1 for k in range(1, 128)}, {65: 1000, 63: 999, 2: 1}, {3: 0}])
def test_patterns_hold_the_demand(demand):
    found, held = packing.patterns(demand, 128), Counter()
    for one, copies in found:
        assert sum(s * n for s, n in one.items()) <= 128 and copies > 0
        for s, n in one.items():
            held[s] += n * copies
    assert held == Counter({s: n for s, n in demand.items() if n})
    if len(demand) > 100:  # near the bound of the total length
        assert sum(c for _, c in found) <= 1.08 * sum(s * n for s, n in demand.items()) / 128 + 2


def test_tokens_equal_the_tokenizer():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tesserae.llm.bpe import Encoder
    from tesserae.llm.common import chunks

    rnd, encoder, exact = random.Random(3), Encoder(*tokenizer_files()), Tokenizer.from_file(tokenizer_files()[0])
    parts = ["a", "s", "'", "'s", "'re", " ", "  ", "\n", "\t", "22", "é", ".", "!!", "’", "中", "L", "\x85", "\x1c", "<|endoftext|>", "̀", "ª", "Ā", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(2000)]
    for lo, hi, data, offs in chunks(pa.array(texts), 4000):
        ids, at = encoder.encode(data, offs)
        for i in range(lo, hi):
            assert ids[at[i - lo] : at[i - lo + 1]].tolist() == exact.encode(texts[i], add_special_tokens=False).ids, repr(texts[i])


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = Counter()
    for _, t, _, s in TEXTS:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:  # sources that are over their limit are fixed there, until none is
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
        open_ -= over
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    largest = defaultdict(int)
    for _, t, _, s in TEXTS:
        largest[s] = max(largest[s], len(words(t)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["k1"], r["taken"]) for r in rows) == sorted((r["k1"], r["taken"]) for r in again)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    assert sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(docs, others=others).collect())
    assert mixing.mix(empty).count() == 0


def test_mixed_documents_keep_rows_that_differ_in_other_columns(spark):
    """Rows of one id, text and source are each placed as often as the mix takes them, with their own columns."""
    rows = [(1, "one two three", "s", "en"), (1, "one two three", "s", "de"), (1, "one two three", "s", "de"), (2, "four", "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    taken = mixing.mix(df, others=["lang"], share=2.0).collect()
    assert sum(r["taken"] for r in taken) == 20
    out = Counter((r["doc_id"], r["lang"]) for r in mixing.mixed_documents(df, share=2.0).collect())
    assert out == {(1, "en"): 2, (1, "de"): 4, (2, None): 2}


def test_demand_time(spark):
    """The inverse of the integrated schedule."""
    import numpy as np

    grid = [(float(x), float(s)) for x in np.linspace(0, 1, 11) for s in (-0.9, 0.0, 0.6)]
    df = spark.createDataFrame(grid, "x double, s double").withColumn("t", mixing.demand_time(F.col("x"), F.col("s")))
    for r in df.collect():
        assert (1 - r["s"]) * r["t"] + r["s"] * r["t"] ** 2 == pytest.approx(r["x"], abs=1e-9)


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", r"<\s> [\\INST] [/\INST]"), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "[/INST]</s><s>user[INST]x"), (3, 5, "a[INST]b", "tail ["), (None, 0, "assistant", "x"), (4, 0, "assistant", "é" * 5000)
]


def test_chat(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash")).withColumn("source", F.lit(1))
    out = chat.format_conversations(df).collect()
    assert all(r["round_trip"] for r in out) and len(out) == 5
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in CONVERSATIONS:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = {r["conv_id"]: r["formatted"] for r in out}
    for r in out:
        under = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        own = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert [re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", x) for x in under] == own
    assert formatted[1].count("</s>") == 3  # only the template's own
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_pii(spark, docs, empty):
    rows = [(1, "Call +1 (017) 555-7713 or 017-555-7713; card 4111 1111 1111 1111 = 4111111111111111, not 4111111111111112."), (2, "ip 97.51.17.173 on 2024-02-29, 29/02/2024, 29.02.2024; bad 2023-02-30; 1.2.3.4.5; Bo.b9@x.example.com"), (3, None), (4, ""), (5, "9" * 40 + " nothing"), (6, "97.51.17.173")]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kinds", F.lit(0)), key="k").collect()}
    one, two = got[1]["text"], got[2]["text"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", one)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and cards[2] == "4111111111111112"
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(cards[1]))) % 10 == 0
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", one)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "0175557713"
    iso, slash, dot = re.search(r"on (\S+), (\S+), (\S+);", two).groups()
    assert iso != "2024-02-29" and iso.split("-") == slash.split("/")[::-1] == dot.split(".")[::-1]
    assert "bad 2023-02-30; 1.2.3.4.5;" in two and "Bo.b9@" not in two and re.search(r"[A-Z][a-z]\.[a-z]\d@x\.example\.com$", two)
    assert got[6]["text"] == re.search(r"ip (\S+) on", two).group(1) != "97.51.17.173"
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1]
    plain = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs, key="k").collect()}
    assert all(plain[i] == t for i, t, *_ in TEXTS)
    assert pii.pseudonymised(empty, key="k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, key="")


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    out = [r[0] for r in df.select(pii.feistel(F.col("v"), "t", "k")).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in out)


@pytest.mark.parametrize("run,label", [(toxicity.toxicity_scores, "toxic"), (quality_model.quality_scores, "quality")])
def test_classifiers_edges(docs, empty, labels, run, label):
    got = run(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in TEXTS)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert run(empty, labels).count() == 0
    assert run(docs, labels.limit(0)).count() == len(TEXTS)


def test_language_edges(docs, empty):
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    assert {got[i]["lang_pred"] for i in (6, 7, 8)} == {"und"}
    assert got[1]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords_lie_apart():
    for n in (2, 3, 4, 5, 20):
        code = language_id.codewords(n, 31)
        near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert near >= (1 if n == 2 else 2 if n == 3 else 4) and (code.min(axis=0) < code.max(axis=0)).all()


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    found = language_id.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.99 * found.count()
    scored = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.9 * scored.count()
    scored = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = toxic").count() >= 0.85 * scored.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.written(docs, name)
        seen[name] = docs
    copies = Counter((r["text"] or "").translate(LOWER) for r in seen["exact_dedup"].collect())
    assert max(copies.values()) == 1
    rows = [(r["doc_id"], r["text"]) for r in seen["exact_dedup"].collect()]
    want = {i for i, (_, c) in brute_components(rows).items() if c == i}
    assert {r["doc_id"] for r in seen["jaccard_join"].collect()} == want
    mixed = Counter(r["doc_id"] for r in seen["mixing"].collect())
    assert set(mixed) <= want and max(mixed.values()) <= 2
    tokens = {r["doc_id"]: r["doc_tokens"] for r in seen["packing"].collect()}
    total = Counter()
    for r in seen["packing"].collect():
        total[r["doc_id"]] += r["length"]
    assert all(total[i] == n * tokens[i] for i, n in mixed.items())


def test_toxicity_grams_are_characters():
    texts = ["", "abc", "ABCD" + "x" * 2000 + "abcdefgh", "abcd\0\0\0\0", "q" * 505 + "abcdefgh" + "q" * 600, "bcdefgh" * 400, "été 中文字 😀 naïve É" * 90, "é" * 511 + "日本語 abcd"]
    grams = [(4, "abcd"), (6, "cdefgh"), (8, "abcdefgh"), (8, "abcd\0\0\0\0"), (8, "hbcdefgh"), (4, "中文字 "), (6, "é 中文字 "), (4, "語 ab"), (8, "😀 naïve ")]
    key = lambda n, g: int(next(k for size, k in zip(toxicity.SIZES, toxicity.gram_keys(np.array([ord(c) for c in g], np.uint64)), strict=True) if size == n)[0])
    keys = sorted((n, key(n, g), g) for n, g in grams)
    kept = toxicity.Kept(np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.uint64))
    coded = [t.encode() for t in texts]
    first, window, feature = kept.windows(np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0] + [len(t) for t in coded]))
    want, begin = set(), [0]
    for t in texts:
        low = t.translate(LOWER)
        blocks = -(-len(t) // toxicity.BLOCK)
        for w in range(max(1, blocks - 1)):
            part = range(w * toxicity.BLOCK, (w + 2) * toxicity.BLOCK)  # where n-grams begin
            want |= {(begin[-1] + w, f) for f, (n, _, g) in enumerate(keys) for a in part if low[a : a + n] == g}
        begin.append(begin[-1] + max(1, blocks - 1))
    assert first.tolist() == begin and set(zip(window.tolist(), feature.tolist(), strict=True)) == want and len(window) == len(want)


def test_toxicity_fit_in_parts():
    """The gradient does not depend on how rows are cut into parts."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 9, 200)
    of, bounds = rng.integers(0, 30, sizes.sum()).astype(np.int32), np.concatenate(([0], np.cumsum(sizes)))
    y, ratio = rng.integers(0, 2, 200).astype(float), rng.normal(size=30)
    a, b = (toxicity.fit(of, bounds, y, np.ones(200), ratio, (np.zeros(30), 0.1), steps=20, per_part=n) for n in (7, 1 << 20))
    assert np.allclose(a[0], b[0]) and np.isclose(a[1], b[1])


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_toxicity_of_long_texts(spark):
    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    held = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect() if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    clean = [r["text"] for r in held if r["toxic"] == 0]
    passage = "you pathetic loser, what a worthless idiot and moron; stupid trash, disgusting scum, clown"
    made, at = {}, 0
    for size in (5000, 20_000, 100_000):
        for k in range(4):
            parts, n = [], 0
            while n < size:
                parts.append(clean[at % len(clean)])
                n += len(parts[-1].split())
                at += 7
            made[-1000 - len(made)] = ("\n".join(parts), 0)
            parts.insert(len(parts) * k // 3, passage)
            made[-1000 - len(made)] = ("\n".join(parts), 1)
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, (t, _) in made.items()], "doc_id long, text string"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(rows, labels).where("doc_id <= -1000").collect()}
    assert got == {i: y for i, (_, y) in made.items()}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_toxicity_held_out_by_length(spark):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    scored = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    length = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if scored[r["doc_id"]]["held_out"]}
    for lo, hi, recall in ((0, 300, 0.8), (300, 10**9, 0.9)):  # some short texts labelled toxic have no toxic word
        found = {k: [scored[i]["predicted"] for i, y in truth.items() if y == k and lo <= length[i] < hi] for k in (0, 1)}
        assert len(found[1]) >= 30 and np.mean(found[1]) >= recall and np.mean(found[0]) <= 0.01
    stage = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, LARGER).select("doc_id").collect()}
    assert stage == {i for i, r in scored.items() if not r["predicted"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_toxicity_stage_follows_each_row(spark):
    import corpus_pipeline

    bad, good = "you pathetic loser, what a worthless idiot and moron; stupid trash, disgusting scum, clown", prose(4, 40)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    own = [(None, bad), (None, good), (-5, bad), (-5, good), (-6, good), (-7, bad), (None, None)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "own", 0) for i, t in own], docs.schema))
    kept = corpus_pipeline.drop_toxic(spark, rows, DATA).where("source = 'own'").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(x for x in own if x[1] != bad)
