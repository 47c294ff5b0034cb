"""Lexical search, decontamination and token alignment against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillwork.llm import decontamination, lexical_search, queries, token_alignment, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = "row term n words data shard score rank key window item items spans block pairs times groups n_words n_hit".split()
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "…", "A", "a a a", "İI ÀÉ straße STRASSE", "a\x00b\x7fc", "one.two_three-four 'five' 6seven", " nb sp ls", "Ω" * 50, "x " * 3000, "日本 語\n語", "tail "]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return WORD.findall(lowered(text))


def frame(spark, data, schema=DOCS, extra=True):
    df = spark.createDataFrame(data, schema)
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns}) if extra else df


def test_words_are_those_of_the_pattern():
    for texts in (ODD, ["ab", "cd"], [None], [], ["é", "", None, "z"]):
        got = words.words_of(pa.array(texts, pa.string()))
        flat = got.array().to_pylist()
        assert [flat[a:b] for a, b in zip(got.bounds, got.bounds[1:])] == [terms(t) for t in texts]
    column = pa.array(ODD * 3, pa.string()).slice(2, 20)
    assert words.words_of(column).array().to_pylist() == [w for t in column.to_pylist() for w in terms(t)]
    runs = words.slices(column, 40)
    assert [a for a, _ in runs][1:] == [b for _, b in runs][:-1] and runs[-1][1] == len(column)


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 56) + 3, *np.random.default_rng(1).integers(0, 1 << 30, 500)])
    data, at = lexical_search.encode_numbers(values)
    assert (lexical_search.decode_numbers(data.tobytes()) == values).all()
    assert (lexical_search.decode_numbers(data[at[3] : at[6]].tobytes()) == values[3:6]).all()
    assert not len(lexical_search.decode_numbers(b""))


def brute_search(docs, items, k):
    have = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in have if c), sum(sum(c.values()) for _, c in have)
    df = Counter(w for _, c in have for w in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in have:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs, shard_bytes, k", [(1 << 14, 1 << 24, 50), (7, 1 << 24, 5), (1 << 14, 900, 3)])
def test_search_equals_brute_force(spark, shard_docs, shard_bytes, k):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ω", "é"]
    texts = [" ".join(draw.choices(vocabulary, weights=range(1, 43), k=draw.randrange(60))) for _ in range(300)]
    docs = [(i if i % 11 else None if i % 2 else 5, t) for i, t in enumerate(texts + texts[:40] + ODD)]
    docs += [(9000, "Lone wolf"), (8999, "lone WOLF"), (8998, "lone.wolf")]
    items = [(0, "w1 W2 w2, w30"), (1, None), (2, ""), (3, "nowhere"), (4, "lone wolf"), (4, "é Ω"), (None, "w41"), (5, " ".join(vocabulary * 20))]
    index = lexical_search.build_index(frame(spark, docs).repartition(3), shard_docs=shard_docs, shard_bytes=shard_bytes)
    assert index.where("term is null").agg(F.max(F.size("doc_ids"))).first()[0] <= shard_docs
    got = lexical_search.search(index, frame(spark, items, "item_id long, text string"), k)
    # null ids tie by score only where texts are equal, so rows compare as sets of values
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(none, items).count() == 0
    assert lexical_search.ranked(spark.createDataFrame([(1, "a")], DOCS), items.where("false")).count() == 0
    assert lexical_search.ranked(spark.createDataFrame([(1, None), (2, "!")], DOCS), items).count() == 0


def test_a_window_of_documents_is_left_out_only_if_none_of_it_can_enter():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 3000
        penalty = 50 + rng.integers(0, 90, n)
        lists = [np.flatnonzero(rng.random(n) < p) for p in (0.9, 0.4, 0.02, 0.001)]
        cursors, sums = [], np.zeros(n, np.int64)
        for place in (p for p in lists if len(p)):
            times = rng.integers(1, 5, len(place))
            stream = np.empty(2 * len(place), np.int64)
            stream[0::2], stream[1::2] = np.diff(place, prepend=0), times
            weight = int(rng.integers(1, 9000))
            cursors.append(lexical_search._Cursor(lexical_search.encode_numbers(stream)[0].tobytes(), weight, penalty))
            sums[place] += weight * (10**9 * times // (1000 * times + 20 * penalty[place]))
        wanted = sorted(((int(s), i) for i, s in enumerate(sums) if s > 0), key=lambda x: (-x[0], x[1]))[:20]
        assert lexical_search.best_of_shard(cursors, 20) == wanted


def brute_leaks(docs, items, window=10):
    of_window = {}
    for item, text in items:
        w = terms(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            of_window.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = sorted({len(w) for w in of_window})
    out = []
    for doc, text in docs:
        w, hit, named = terms(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                found = of_window.get(tuple(w[i : i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    named |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_cases():
    draw = random.Random(8)
    say = lambda n: [f"v{draw.randrange(25)}" for _ in range(n)]
    items = [(i, " ".join(say(draw.choice([1, 2, 3, 9, 10, 11, 40])) if i % 3 else say(30))) for i in range(60)]
    items += [(3, "same id other text goes on for twelve whole words here you see"), (None, "zz yy xx ww vv uu tt ss rr qq pp"), (70, None), (71, ""), (72, "?!"), (73, items[0][1]), (74, "Ünï ÇÖDÉ")]
    docs = [(i, " ".join(say(200))) for i in range(60)]
    for i in range(60):
        a, b = say(draw.randrange(300)), say(draw.randrange(20))
        docs.append((100 + i, " , ".join([*a, *items[i % 60][1].upper().split(), *b])))
    docs += [(500 + i, t) for i, t in enumerate(ODD)] + [(None, items[0][1]), (7, items[0][1]), (7, "zz.yy-xx WW vv\nuu tt ss rr qq"), (8, " ".join(say(60_000)) + " " + items[3][1]), (9, "ünï Çödé"), (9, "Ünï ÇÖDÉ")]
    return docs, items


@pytest.mark.parametrize("block", [decontamination.BLOCK, 40])
def test_decontamination_equals_brute_force(spark, block):
    docs, items = leak_cases()
    got = decontamination.contamination_report(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"), block=block)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_leaks(docs, items)


def test_occurrences_are_told_by_place(spark):
    docs = frame(spark, [(1, "x a b c y a b c"), (2, "a b"), (3, None)])
    items = frame(spark, [("p", "A b, c"), ("q", "b c d")], "item_id string, text string")
    for block in (100, 1):
        found = {r["doc_id"]: r for r in decontamination.occurrences(docs, items, window=2, block=block).collect()}
        assert [tuple(s) for s in found[1]["spans"]] == [(1, 2), (2, 3), (5, 6), (6, 7)] and found[1]["items"] == ["p", "q"]
        assert [tuple(s) for s in found[2]["spans"]] == [(0, 1)] and found[2]["items"] == ["p"]
        assert found[3]["spans"] == [] and found[3]["items"] == [] and found[3]["n_words"] == 0
    kept = decontamination.decontaminate(docs, items, window=2)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]
    assert decontamination.decontaminate(docs, items, most=0.8, window=2).count() == 2


def test_decontamination_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), frame(spark, [(1, "a")])
    items = frame(spark, [(1, "a")], "item_id long, text string")
    assert decontamination.contamination_report(none, items).count() == 0
    assert [r["n_hit"] for r in decontamination.contamination_report(one, items.where("false")).collect()] == [0]


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.Tokenizers(token_alignment.BYTE_LEVEL, token_alignment.PIECES)


def brute_alignment(tok, docs):
    rows, linked = [], Counter()
    for doc, text in docs:
        a = tok.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(tok.spelt_a[i] for i in a) != raw or b"".join(tok.spelt_b[i] for i in b) != raw:
            rows.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(tok.spelt_a[i]) for i in a]).tolist(), np.cumsum([len(tok.spelt_b[i]) for i in b]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        linked.update(links)
        rows.append((doc, a, b, groups, links))
    best = Counter()
    for (_, b), n in linked.items():
        best[b] = max(best[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, len(a), len(b), len(g), len(ln), sum(linked[x] == best[x[1]] for x in ln), sum(linked[x] for x in ln), digest(g)) for d, a, b, g, ln in rows), key=str)


ALIGNED = [*ODD, "<|endoftext|> <s></s> <unk> plain", "a▁b c", "two  spaces   three", " lead", "\n\nlines\n\n x\ny\r\nz\t\tq", "nul\0 in text", "it's we'll I'd", "x y z 　w", "a  b", "🙂🙂 ok 🙂", "-" * 300, "ab" * 700, "word " * 40 + "\n" + "word\n" * 9, "▁", "é é ﬁ Ⅳ", "\x1c x \x85y"]


def test_alignment_equals_brute_force(spark, tokenizers, sf_dir, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ALIGNED + ALIGNED[:9])] + [(None, "no id here"), (3, "an id again")]
    got = token_alignment.alignment_report(frame(spark, docs).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(tokenizers, docs)


def test_alignment_over_many_small_shards(spark, tokenizers, monkeypatch):
    docs = [(i, f"some words {i} that {i % 7} come, and {i % 3} go\nagain") for i in range(200)]
    monkeypatch.setattr(token_alignment, "SHARD", 20)
    aligned = token_alignment.write_table(token_alignment.align(frame(spark, docs).repartition(5)), "aligned")
    shards, best = token_alignment.pair_counts(aligned)
    assert len(shards) > 3
    counts = Counter(k for r in aligned.collect() for k, n in zip(r["pairs"], r["times"]) for _ in range(n))
    keys = np.array(sorted([*counts, 5, 1 << 60]))
    assert token_alignment.look_up(shards, keys).tolist() == [counts.get(k, 0) for k in keys.tolist()]
    assert all(best[b] == max(n for k, n in counts.items() if k >> 32 == b) for b in {k >> 32 for k in counts})
    assert all(type(s.columns()[0]) is np.memmap for s in shards)
    got = token_alignment.alignment_report(frame(spark, docs).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(tokenizers, docs)


def test_what_a_task_remembers_changes_nothing(tokenizers, monkeypatch):
    texts = [t for t in ALIGNED if t]
    plain = token_alignment.Aligner(tokenizers).texts(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    small = token_alignment.Aligner(tokenizers)
    for _ in range(2):
        one_by_one = [small.texts([t]) for t in texts]
        assert np.concatenate([x[0] for x in one_by_one]).tolist() == plain[0].tolist()
        assert np.concatenate([x[3] for x in one_by_one]).tolist() == plain[3].tolist()
        assert [x[5][0] for x in one_by_one] == plain[5]


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment_report(spark.createDataFrame([], DOCS)).count() == 0
    nothing = token_alignment.alignment_report(spark.createDataFrame([(1, None), (2, "▁")], DOCS)).orderBy("doc_id").collect()
    assert [tuple(r) for r in nothing] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_queries_are_registered():
    assert {"op11_token_alignment", "op12_decontamination", "op13_lexical_search"} <= set(queries.QUERIES)
