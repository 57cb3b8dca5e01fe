import collections
import gzip
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.llm import decontaminate, html_wrapper, langid, near_dup, ogg, packing, sharding, token_files, tokens, toxicity, warc
from sigloom.llm.common import fresh_name

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, no words, ties, repeated rows, rows without an id, a long text.
ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "Ünïcode ß 日本 !!! ???"), (5, "same words here again and again for ever"), (6, "same words here again and again for ever"), (6, "same words here again and again for ever"), (None, "text without an id"), (8, "word " * 30_000), (9, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def clashing(df):
    """Extra columns named as operators name theirs."""
    names = ["score", "lang_pred", "shard", "slot", "piece", "start", "n_hit", "items", "spans", "node", "a", "b", "text_", "class_id", "key"]
    return df.withColumns({n: F.lit(n) for n in names})


def prose(rng, n, vocabulary=800):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# Sharding


def test_shards_are_even_gapless_and_stable(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(2000)) for i in range(3000)]
    got = sharding.shard(clashing(frame(spark, rows)), 24).collect()
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and max(loads.values()) < 1.002 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    by_id = dict(rows)
    assert all(r["size"] == len(by_id[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]].encode()) for r in got)


def test_slot_maps_are_loaded_edited_and_kept(spark, tmp_path):
    rng, path = random.Random(8), f"file://{tmp_path}/map"
    rows = [(i, "x" * rng.randrange(3000)) for i in range(4000)]
    first = sharding.shard(frame(spark, rows), 6, map_path=path).collect()
    assert sharding.latest_version(spark, path) == 1 and {r["map_version"] for r in first} == {1}
    assert sharding.shard(frame(spark, rows), 6, map_path=path).where("map_version <> 1").count() == 0  # balanced: no new version
    grown = [*rows, *((10_000 + i, "y" * 2000) for i in range(150))]
    second = sharding.shard(frame(spark, grown), 6, map_path=path).collect()
    old, new = ({r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    moved = sum(old[s] != new[s] for s in old)
    assert {r["map_version"] for r in second} == {2} and 0 < moved < 0.02 * sharding.SLOTS and len(new) == sharding.SLOTS
    loads = collections.Counter()
    for r in second:
        loads[r["shard"]] += r["size"]
        assert r["shard"] == new[r["virtual_slot"]]
    assert max(loads.values()) < 1.002 * min(loads.values())
    third = sharding.shard(frame(spark, grown), 7, map_path=path).collect()
    assert {r["shard"] for r in third} == set(range(7)) and sharding.latest_version(spark, path) == 3
    with pytest.raises(ValueError):
        sharding.next_map(spark, path, {}, 7, slots=16)


def test_sharding_edge_cases(spark):
    got = sharding.shard(frame(spark, ODD), 4).collect()
    assert len(got) == len(ODD) and {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2, 9)} == {(8, 0)}
    assert sharding.shard(frame(spark, []), 4).count() == 0
    plain = [s % 3 for s in range(12)]
    edited, edits = sharding.rebalance(plain, {s: (100 if s % 3 == 0 else 1, 1) for s in range(12)}, 3)
    loads = collections.Counter()
    for s, shard in enumerate(edited):
        loads[shard] += 100 if s % 3 == 0 else 1
    assert edits and max(loads.values()) <= 205


# Decontamination


def brute_matches(docs, items, window):
    word = lambda t: decontaminate.words_of(t)
    out = {}
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    for doc, text in docs:
        w, hit, found = word(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        out[doc] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_suffix_array_matching_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(f"i{k}", " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 4, 7, 12])))) for k in range(6)]
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(40)))) for k in range(20)]
    block = decontaminate.Block(items, 4)
    documents = [decontaminate.words_of(t) for _, t in docs]
    bounds, hit, doc, which, length = decontaminate.match_shard(documents, block)
    want = brute_matches(docs, items, 4)
    for k, _ in docs:
        n_hit = int((hit[bounds[k] : bounds[k + 1]] > 0).sum())
        found = sorted({i for d, w in zip(doc, which, strict=True) if d == k for i in block.holders[w]})
        assert (len(documents[k]), n_hit, found) == want[k]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_longest_match_tries_every_place(seed):
    rng = random.Random(seed)
    starts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(2)]
    items = [(f"i{k}", rng.choice(starts) + " " + " ".join(rng.choice("abc") for _ in range(rng.randrange(10)))) for k in range(8)] + [("s", "a b")]
    texts = [" ".join(rng.choice("abcd") for _ in range(5)) + " " + rng.choice(items)[1] + " " + rng.choice("abcd") for _ in range(12)]
    words = [decontaminate.words_of(t) for _, t in items]
    _, _, doc, _, length = decontaminate.match_shard([decontaminate.words_of(t) for t in texts], decontaminate.Block(items, 4))
    for k, text in enumerate(texts):
        w, want = decontaminate.words_of(text), 0
        for item, at, p in ((x, at, p) for x in words for at in range(len(w)) for p in range(len(x))):
            n = next((j for j in range(len(w) + 1) if w[at : at + j + 1] != item[p : p + j + 1] or j == min(len(w) - at, len(item) - p)), 0)
            want = max(want, n if n >= min(4, len(item)) else 0)
        assert max(length[doc == k], default=0) == want


def test_decontamination_over_blocks_and_edges(spark):
    rng = random.Random(2)
    bench = [(k, prose(rng, 30)) for k in range(7)] + [(None, prose(rng, 12)), (20, None), (21, "!!!"), (3, "short one")]
    rows = ODD + [(100 + k, prose(rng, 50) + " " + bench[k][1] + " " + prose(rng, 20)) for k in range(8)] + [(200, "a SHORT one, indeed")]
    b = spark.createDataFrame(bench, "item_id int, text string")
    for block_items in (3, 20_000):
        found = decontaminate.find_matches(clashing(frame(spark, rows)), b, ["doc_id"], block_items=block_items, shard_words=40)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.collect()}
        assert got == {k: (n, h, i) for k, (n, h, i) in brute_matches(rows, [(None if k is None else str(k), t) for k, t in bench], 10).items()}
    kept = decontaminate.remove_contaminated(clashing(frame(spark, rows)), b)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v[1]} and kept.columns == clashing(frame(spark, rows)).columns
    assert decontaminate.remove_contaminated(frame(spark, rows), b.where("false")).count() == len(rows)
    assert decontaminate.find_matches(frame(spark, []), b, ["doc_id"]).count() == 0


# Tokens, packing, token files


def test_chunked_encoding_is_exact():
    path = tokens.default_path()
    t = tokens.tokenizer(path)
    rng, letters = random.Random(3), "aAbßéÉİΣς.,;'’!*<|≯́ \n\t\x1c\x85\xa019½٣한😀ªº"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["İ. ΣΑΣ. don't x'sword .'s", "<|startoftext|> a<|endoftext|>. <|ENDOFTEXT|>", "", "ﬁ ŉ ǰ. क़."]
    for text, got in zip(texts, tokens.encode(texts, path), strict=True):
        assert got == np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes(), text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(0, 99))
def test_packing_plans_hold_every_piece_once(lengths, seed):
    counts = collections.Counter(lengths)
    plan = packing.best_fit(counts, 40)
    before = plan.bins
    packing.local_search(plan)
    used = collections.Counter()
    for pattern, n in plan.classes.items():
        assert packing.fill_of(pattern) <= 40
        for length, k in pattern:
            used[length] += k * n
    assert used == counts and -(-sum(lengths) // 40) <= plan.bins <= before


def test_local_search_exchanges_help():
    plan = packing.Plan(10)
    for pattern, n in ((((6, 1), (3, 1)), 2), (((4, 1), (3, 1)), 1), (((1, 2),), 1)):
        plan.add(pattern, n)
    packing.local_search(plan)
    assert plan.bins == 3 == -(-(18 + 7 + 2) // 10)
    with pytest.raises(ValueError):
        packing.best_fit({11: 1}, 10)


def test_local_search_ends_only_when_no_exchange_helps():
    """Brute force over all pairs of bins finds none left; long pieces make the search move thousands of them."""
    rng = np.random.default_rng(3)
    counts = collections.Counter(rng.integers(24, 70, 3000).tolist())
    plan = packing.best_fit(counts, 100)
    squares = lambda: sum(packing.fill_of(p) ** 2 * n for p, n in plan.classes.items())
    before, bins = squares(), plan.bins
    made = packing.local_search(plan)
    used = collections.Counter()
    for pattern, n in plan.classes.items():
        used.update({length: k * n for length, k in pattern})
    assert made > 20 and squares() > before and plan.bins <= bins and used == counts
    if plan.bins > -(-sum(k * n for k, n in counts.items()) // 100):
        for full, low in itertools.product(plan.classes, repeat=2):
            fill, gap = packing.fill_of(full), 100 - packing.fill_of(full)
            if fill < packing.fill_of(low) or full == low and plan.classes[low] < 2:
                continue
            ones, twos = ([sum(c) for c in set(itertools.combinations([x for x, n in low for _ in range(min(n, 2))], k))] for k in (1, 2))
            back, pair = ([sum(c) for c in set(itertools.combinations([x for x, n in full for _ in range(min(n, 2))], k))] for k in (1, 2))
            shifts = [t for t in ones] + [t - g for t in ones + twos for g in back] + [t - g for t in ones for g in pair]
            assert not any(0 < x <= gap for x in shifts)


def test_packing_columns_that_clash(spark):
    pieces = spark.createDataFrame([(k, 0, 10 + k, "x") for k in range(8)], "doc_id long, piece int, length long, sequence_id string").withColumns({n: F.lit(7) for n in ("length_", "part_", "parts_", "rows_", "base_", "place_", "number_", "offset")})
    got = packing.pack(pieces, 40)
    assert got.columns == [*pieces.columns, "_sequence_id", "_offset"]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(8)) and all(r["sequence_id"] == "x" and r["offset"] == 7 for r in rows)


def test_other_tokenizers_encode_whole_texts():
    import os

    folder = os.path.dirname(tokens.default_path())
    assert tokens.by_word(tokens.default_path())
    for name in ("byte_bpe_50k.json",):
        path = os.path.join(folder, name)
        assert not tokens.by_word(path)
        texts = ["two  spaces\nand a line", None, "Ünï 12"]
        want = [np.array(tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in texts]
        assert tokens.encode(texts, path) == want


def test_packed_documents(spark):
    rng = random.Random(4)
    rows = ODD + [(100 + k, prose(rng, rng.randrange(300))) for k in range(200)]
    path = tokens.default_path()
    got = packing.pack_documents(clashing(frame(spark, rows)), capacity=256, keep_ids=True)
    pieces = got.collect()
    by_doc, places = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
    for place in places.values():
        end = 0
        for offset, length in sorted(place):
            assert offset == end
            end += length
        assert end <= 256
    for doc, text in rows:
        if doc not in (6, None):
            ids = sum((p["ids"] for p in sorted(by_doc[doc], key=lambda p: p["piece"])), [])
            assert np.array(ids, "<u4").tobytes() == tokens.encode([text], path)[0]
            assert all(p["start"] == 256 * p["piece"] for p in by_doc[doc])
    total = sum(p["length"] for p in pieces)
    assert len(places) <= 1.02 * total / 256 + 1
    assert sum(len(r["ids"]) for r in packing.sequences(got).collect()) == total
    assert packing.pack_documents(frame(spark, [])).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=400))
def test_repair_round_trip_and_random_access(ids):
    x = np.array(ids, np.uint32)
    symbols, rules, starts = token_files.repair(x, 6, min_count=2)
    assert (token_files.expand(symbols, rules, starts, 6) == x).all()
    block = token_files.Block(token_files.write_block([1, None], [x[: len(x) // 2].astype("<u4").tobytes(), x[len(x) // 2 :].astype("<u4").tobytes()]))
    assert block.doc_ids == [1, None] and (block.all_ids() == x).all()
    for a in range(0, len(x), 17):
        assert (block.ids(a, min(len(x), a + 9)) == x[a : a + 9]).all()


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    for x in (np.tile(rng.integers(0, 50_000, 2000), 40), np.zeros(5000, int), rng.integers(0, 3, 20_000)):
        x = x.astype(np.uint32)
        symbols, rules, starts = token_files.repair(x, 50_000)
        left = symbols.tolist()
        counts, last = collections.Counter(), None
        for k, pair in enumerate(zip(left, left[1:])):
            if last != (pair, k - 1):
                counts[pair] += 1
                last = (pair, k)
        assert max(counts.values(), default=0) < token_files.MIN_COUNT and (token_files.expand(symbols, rules, starts, 50_000) == x).all()


def test_token_files_read_back(spark):
    rng = random.Random(5)
    rows = ODD + [(1000 - k, prose(rng, rng.randrange(200))) for k in range(300)]
    files = token_files.write_files(clashing(frame(spark, rows)), block_ids=5000)
    got = token_files.read_files(files).collect()
    order = sorted(((-1 if i is None else i, zlib.crc32((t or "").encode())), t) for i, t in rows)
    ids = dict(zip([k for k, _ in order], tokens.encode([t for _, t in order], tokens.default_path()), strict=True))
    at = 0
    for key, _ in order:
        r = next(r for r in got if (-1 if r["doc_id"] is None else r["doc_id"]) == key[0] and r["start"] == at)
        assert bytes(r["ids"]) == ids[key]
        at += len(ids[key]) // 4
    assert token_files.read_files(token_files.write_files(frame(spark, []))).count() == 0
    with pytest.raises(ValueError):
        token_files.Block(token_files.write_block([1], [b"\1\0\0\0"])[:-1] + b"x")


# Near duplicates


def plain_vectors(texts):
    """Shingle weights written out: words, five at a time, tf * (1 + idf / 4), idf from 1 at 0.2 % of the rows to 0 at all."""
    words = [re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    counts = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w) for w in words]
    df = collections.Counter(x for c in counts for x in c)
    idf = {x: math.log(len(texts) / max(n, 0.002 * len(texts))) / math.log(1 / 0.002) for x, n in df.items()}
    return [{x: tf * (1 + idf[x] / 4) for x, tf in c.items()} for c in counts]


def plain_similarity(a, b):
    shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1e-9)


def brute_classes(spark, rows):
    """Class ids by all pairs, without any of the operator's functions."""
    vectors, first = {}, {}
    for (i, t), v in zip(rows, plain_vectors([t for _, t in rows]), strict=True):
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
            vectors[t or ""] = v
    vectors = {i: vectors[t] for t, i in first.items()}
    parent = {i: i for i in vectors}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(vectors):
        for x in vectors[i]:
            holders[x].append(i)
    for a, b in sorted({p for h in holders.values() for p in itertools.combinations(h, 2)}):
        if plain_similarity(vectors[a], vectors[b]) >= 0.8:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(i, t): root(first[t or ""]) if (t or "") in first else None for i, t in rows}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    rows = list(ODD)
    for g in range(12):
        base = prose(rng, 120, 5000)
        rows += [(1000 + 100 * g + k, edited(rng, base, rng.randrange(5))) for k in range(8)]
    shared = prose(rng, 60, 5000)
    rows += [(5000 + k, shared + " " + prose(rng, 60, 5000)) for k in range(30)]
    want = brute_classes(spark, rows)
    got = near_dup.near_duplicates(clashing(frame(spark, rows))).collect()
    texts = {i: t for i, t in rows}
    assert len(got) == len(rows) and all(r["class_id"] == want[r["doc_id"], texts[r["doc_id"]]] for r in got if r["doc_id"] is not None)
    kept = near_dup.keep_one(clashing(frame(spark, rows)))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for (i, _), c in want.items() if i is not None}) and ids.count(None) == 1
    assert kept.columns == clashing(frame(spark, rows)).columns
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_sketches_estimate_weighted_jaccard():
    rng, idf, off = np.random.default_rng(0), np.ones(near_dup.COUNTERS), []
    idf[::20] = 0.2
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate((a[30:], rng.integers(0, 1 << 63, 30, dtype=np.uint64))))
        x, y = ((h, near_dup.weights(h, np.ones(len(h)), idf)) for h in (a, b))
        off.append((near_dup.sketch(*x) == near_dup.sketch(*y)).mean() - near_dup.weighted_jaccard(x, y))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_components_of_chains_and_stars(spark, monkeypatch):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    for local in (1, 200_000):
        monkeypatch.setattr(near_dup, "LOCAL_LINKS", local)
        got = {r["node"]: r["label"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
        assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 130))
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_group_verifies_in_proportion_to_its_members(monkeypatch):
    rng, base = random.Random(4), prose(random.Random(3), 150, 5000)
    texts = [edited(rng, base, rng.randrange(9)) for _ in range(200)]
    idf, calls = np.ones(near_dup.COUNTERS), []
    vectors = [(lambda h, tf: (h, near_dup.weights(h, tf, idf)))(*near_dup.shingles(t)) for t in texts]
    drawn = [near_dup.sketch(*v) for v in vectors]
    exact = near_dup.weighted_jaccard
    monkeypatch.setattr(near_dup, "weighted_jaccard", lambda a, b: calls.append(1) or exact(a, b))
    got = dict(near_dup.unit_links(range(200), [x.astype(np.uint8).tobytes() for x in drawn], [near_dup.band_keys(x).tolist() for x in drawn], [None] * 200, texts, None, idf))
    links = [(a, b) for a, b in itertools.combinations(range(200), 2) if exact(vectors[a], vectors[b]) >= 0.8]
    assert len(links) > 3000 and len(calls) < 2000
    assert all(got.get(a, a) == got.get(b, b) for a, b in links)


def test_all_pairs_of_large_groups_and_buckets_meet(spark, monkeypatch):
    """Past the limits of a unit, by members and by bytes, with parts of groups and with parts of buckets."""
    buckets = spark.createDataFrame([(7, k, 0) for k in range(40)] + [(100 + k // 2, k, 2 * (k // 2)) for k in range(40)], "key long, node long, least long")
    groups = spark.createDataFrame([(0, k, 100) for k in range(40)], 'group long, node long, bytes long')
    for members, size, bands in ((8, 1 << 24, 36), (8, 1 << 24, 2), (256, 5000, 36), (256, 1 << 24, 36)):
        monkeypatch.setattr(near_dup, "UNIT_MEMBERS", members)
        monkeypatch.setattr(near_dup, "UNIT_BYTES", size)
        monkeypatch.setattr(near_dup, "BANDS", bands)
        units = collections.defaultdict(list)
        for r in near_dup._units(groups, buckets).collect():
            units[r["unit"]].append((r["node"], r["side"]))
        met = [tuple(sorted((a, b))) for u in units.values() for (a, s), (b, t) in itertools.combinations(u, 2) if s is None or s != t]
        assert set(met) == set(itertools.combinations(range(40), 2))
        assert bands == 2 or len(met) == len(set(met))


def test_classes_do_not_depend_on_the_size_of_a_unit(spark, monkeypatch):
    rng = random.Random(11)
    base = prose(rng, 120, 5000)
    texts = [(k, edited(rng, base, 1 + k % 4)) for k in range(60)]
    want = brute_classes(spark, texts)
    for members, bands in ((256, 36), (8, 36), (8, 4)):
        monkeypatch.setattr(near_dup, "UNIT_MEMBERS", members)
        monkeypatch.setattr(near_dup, "_units", lambda g, b, f=near_dup._units, n=bands: _with(near_dup, "BANDS", n, f, g, b))
        got = near_dup.near_duplicates(frame(spark, texts)).collect()
        monkeypatch.undo()
        assert len(got) == 60 and all(r["class_id"] == want[texts[r["doc_id"]]] for r in got)


def test_a_bucket_of_more_than_4096_texts(spark):
    """4500 texts with one sentence of their own each: all in one class, and one text apart that shares half."""
    rng = random.Random(12)
    base = prose(rng, 90, 5000)
    rows = [(k, f"{base} {k}") for k in range(4500)] + [(9000, " ".join(base.split()[:40]) + " " + prose(rng, 60, 5000))]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got.pop(9000) == 9000 and set(got.values()) == {0} and len(got) == 4500


def _with(module, name, value, f, *args):
    before = getattr(module, name)
    setattr(module, name, value)
    try:
        return f(*args)
    finally:
        setattr(module, name, before)


# Learned filters


def test_language_identification_held_out(spark):
    rng = random.Random(7)
    parts = {"xx": "ka lo mi nu pe".split(), "yy": "sch ung ein kei ver".split(), "zz": "tion aux eau oi ré".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30)), x, "s", 0) for i in range(300) for x in [rng.choice("xyz") * 2]]
    df = clashing(spark.createDataFrame([*rows, *((1000 + (i or 0), t, None, "s", 0) for i, t in ODD)], DOCS))
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.98
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == got[1003]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and {1001, 1002, 1003} & {r["doc_id"] for r in kept.collect()} == set()
    none = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.identify(df, none, ["doc_id"]).collect()} == {"und"}
    assert fresh_name(df, "score") == "_score" and langid.identify(df.where("false"), model, ["doc_id"]).count() == 0


def test_rare_languages_and_late_text_are_learnt(spark):
    rng, parts = random.Random(10), {"xx": "ka lo mi nu pe".split(), "yy": "sch ung ein kei ver".split(), "zz": "tion aux eau oi ré".split()}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(x), x, "s", 0) for i in range(3000) for x in [rng.choice(["xx", "yy"])]] + [(5000 + k, "0123 " * 1000 + text("zz"), "zz", "s", 0) for k in range(9)]
    rows += [(6000 + k, "1 2 3", "xx", "s", 0) for k in range(500)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), sample=90)
    assert model.languages == ["xx", "yy", "zz"]
    wanted = [rng.choice(list(parts)) for _ in range(60)]
    assert model.decide([text(x) for x in wanted])[0] == wanted
    assert [langid.bound_each(c, 90) for c in ([5, 500, 500], [100] * 200, [3, 4], [])] == [42, 1, 4, 1]


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.3
        words = prose(rng, 60).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(60), rng.choice(["grumble", "idiot", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    df = clashing(frame(spark, rows + [(2000 + (i or 0), t) for i, t in ODD]))
    marks = spark.createDataFrame([*labels, (2001, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    assert "grumble" in model.lexicon
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, ["doc_id"]).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.keep_harmless(df, model)
    assert kept.columns == df.columns and kept.count() == sum(s < 0.5 for s in got.values()) + sum(1 for i, _ in ODD if i == 6) - 1
    flat = toxicity.fit(df, marks.where("toxic = 0"))
    assert set(flat.score(["x", None])) == {0.0} and toxicity.score(df.where("false"), model, ["doc_id"]).count() == 0


def test_isotonic_values_rise():
    rng = np.random.default_rng(1)
    raw = rng.standard_normal(500)
    points, values = toxicity.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(values) > 0).all() and (np.diff(points) > 0).all()


# Archives, pages, media


def test_archives_round_trip(spark):
    rows = [(1, "http://a/b c", "x" * 200), (2, None, "x" * 200), (3, "http://a", "small"), (4, "http://b", "small"), (5, "u", None), (0, "http://z\n", "x" * 200), (6, "http://é", "ü" * 50), (6, "http://é", "ü" * 50), (None, "n", "y" * 150)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload_digest string")
    arcs = warc.write_arcs(pages, file_bytes=300)
    assert {r["version"] for r in arcs.collect()} == {1, 2}
    got = warc.read_warcs(warc.convert(arcs), with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h for i, _, h in rows if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["record_type"] == "revisit" or bytes(r["payload"]).decode() == text
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(0, "response", None): 1, (1, "revisit", 0): 1, (2, "revisit", 0): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (6, "revisit", 6): 1, (None, "response", None): 1}
    assert warc.read_warcs(warc.convert(warc.write_arcs(pages.where("false")))).count() == 0


def test_arc_versions_plain_and_cut_off():
    for version in (1, 2):
        data = warc.arc_version_block(version, "20010101000000", "f") + warc.arc_record(version, "http://a/b c", "20010203", b"HTTP/1.0 200\r\n\r\nhi", "f", 0) + warc.arc_record(version, "u", "2001", b"raw body", "f", 1)
        records = list(warc.arc_records(data))
        assert [r[1]["URL"] for r in records[1:]] == ["http://a/b c", "u"] and warc.split_http(records[1][2]) == (b"HTTP/1.0 200\r\n\r\n", b"hi")
        assert len(list(warc.arc_records(data[:-5]))) == 2
        whole = [data, gzip.compress(data), b"".join(gzip.compress(d) for d in (data[:-60], data[-60:]))[: len(gzip.compress(data[:-60]))], gzip.compress(data)[:-9]]
        assert [r[1]["URL"] for r in warc.arc_records(whole[1])] == [r[1]["URL"] for r in records]
        assert 1 <= len(list(warc.arc_records(whole[3]))) <= 3 and list(warc.arc_records(gzip.compress(data)[:40]))[3:] == []
        parts = gzip.compress(warc.arc_version_block(version, "20010101000000", "f")) + gzip.compress(data[len(warc.arc_version_block(version, "20010101000000", "f")) :])
        assert len(list(warc.arc_records(parts))) == 3
    assert warc.warc_date("20010203") == "2001-02-03T00:00:00Z" and warc.warc_date("") == "0001-01-01T00:00:00Z"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site <a href="/">home</a></header><nav><ul>{nav}</ul></nav><div class="cookie-notice">We use cookies</div>
<{main}><h1>Title {k}</h1>{body}<form><input><button>Send</button></form></{main}><section id="comments"><article><p>First!</p></article></section><aside>More</aside><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_wrappers_extract_main_text(spark):
    rng, rows, want = random.Random(9), [], {}
    for k in range(30):
        host, main = ("a", "article") if k % 3 else ("b", "main")
        paragraphs = [prose(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{p.replace('w1', 'w1 &amp; &eacute;', 1)}" + ("</p>" if rng.random() < 0.8 else "") for p in paragraphs)
        rows.append((k, f"http://{host}.org/{k}", PAGE.format(nav="".join(f"<li><a href='/{j}'>n{j}</a></li>" for j in range(rng.randrange(1, 6))), main=main, k=k, body=body)))
        want[k] = "\n".join([f"Title {k}"] + [p.replace("w1", "w1 & é", 1) for p in paragraphs])
    rows += [(100, None, None), (101, "x", ""), (102, "http://a.org/9", "<p>cut <b"), (103, "http://c.org/", "plain &lt; text")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_wrapper.extract(pages).collect()}
    assert all(got[k]["text"] == t and got[k]["n_chars"] == len(t) for k, t in want.items())
    assert got[100]["text"] == got[101]["text"] == "" and got[103]["text"] == "plain < text"
    assert html_wrapper.extract(pages.where("false")).count() == 0


def test_texts_have_the_place_of_their_slots():
    """Where a page follows its wrapper, the slots decide, whatever its own elements say."""
    page = "<div><p>%s</p></div><div><p>%s</p></div>"
    wrapper = html_wrapper.infer([page % ("a b", "c d"), page % ("e f", "g h")])

    def marked(nodes, places):
        return [["S", None, places.pop(0)] if n[0] == "S" else n if n[0] == "T" else [*n[:2], marked(n[2], places)] for n in nodes]

    assert html_wrapper.main_text(page % ("one", "two"), wrapper) == "one\ntwo"
    slots = json.dumps(wrapper).count('"S"')
    assert html_wrapper.main_text(page % ("one", "two"), marked(wrapper, [""] * slots)) == ""
    assert html_wrapper.main_text(page % ("one", "two") + "<p>beyond</p>", marked(wrapper, [""] * slots)) == "beyond"


def test_names_in_class_and_id():
    text = "<body><article><div class='%s'>inner</div><p>rest</p></article></body>"
    for name in ("market-share", "side-note", "header-image alt", "noticeable", "shareholder", "banner_ship", "adele"):
        assert html_wrapper.main_text(text % name, []) == "inner\nrest"
    for name in ("ad", "ad-slot-3", "cookie_banner", "share-buttons", "sidebar", "site-header", "x notice", "comments-list", "related-posts"):
        assert html_wrapper.main_text(text % name, []) == "rest"


def test_deep_markup_and_hosts_without_main_elements(spark):
    deep = "<div><section>" * 5000 + "deep text" + "</section></div>" * 5000
    assert html_wrapper.main_text(deep, html_wrapper.infer([deep, deep])) == "deep text"
    rng, rows, want = random.Random(13), [], {}
    for k in range(40):
        parts = [prose(rng, rng.randrange(3, 20)) for _ in range(rng.randrange(1, 5))]
        rows.append((k, f"http://h{k % 2}.org/{k}", f"<body><div class=top>Our site</div><div id=menu><a href=/>x</a> <a href=/y>y{k}</a></div><div class=c>" + "".join(f"<p class='share-price'>{p}</p>" for p in parts) + "</div><section>All rights reserved</section></body>"))
        want[k] = "\n".join(parts)
    rows.append((99, "http://h9.org", deep))
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want | {99: "deep text"}


def test_wrapper_generalises():
    pages = [f"<div><h1>{k}</h1><ul>{'<li>a</li>' * n}</ul>{'<p>x</p>' if k % 2 else ''}</div>" for k, n in enumerate((1, 3, 2))]
    wrapper = html_wrapper.infer(pages)
    unseen = html_wrapper.stream("<div><h1>9</h1><ul>" + "<li>b</li>" * 7 + "</ul></div>")
    slots = {}
    assert html_wrapper.along(wrapper, unseen, 0, slots) == (len(unseen), True) and len(slots) == 8


def test_pages_without_a_main_element_keep_their_text(spark):
    comments = "<section class='comments'><article><p>First!</p></article></section>"
    rows = [(k, f"http://mixed.org/{k}", f"<body><article><p>story {k}</p></article></body>") for k in range(12)]
    rows += [(100 + k, f"http://mixed.org/x/{k}", f"<body><div><p>plain {k}</p></div>{comments * (k % 2)}</body>") for k in range(12)]
    rows += [(200, None, "<main>a</main>"), (201, None, "<p>b</p>"), (300, "http://c.org/", f"<body><p>alone</p>{comments}</body>")]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k}" and got[100 + k] == f"plain {k}" for k in range(12))
    assert (got[200], got[201], got[300]) == ("a", "b", "alone")


def test_only_text_equal_on_all_pages_is_template(spark):
    page = "<body><p>Site name</p><h1>{}</h1><div><p>text {}</p></div>{}</body>"
    rows = [(k, f"http://a.org/{k}", page.format("News" if k < 60 else f"Report {k}", k, "")) for k in range(64)]
    rows += [(100 + k, f"http://b.org/{k}", page.format("News", k, "only here" if k == 1 else "")) for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == ("News" if k < 60 else f"Report {k}") + f"\ntext {k}" for k in range(64))
    assert all(got[100 + k] == f"text {k}" + "\nonly here" * (k == 1) for k in range(12))


def test_long_sample_pages_are_aligned_whole(spark):
    rows = [(k, f"http://a.org/{k}", "<body>" + "".join(f"<h2>h{k}</h2><p>p{k}</p>" for _ in range(400)) + "<div><p>end of page</p></div></body>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join([f"h{k}", f"p{k}"] * 400) for k in range(20))
    deep = "<div><section>" * 3000 + "x" + "</section></div>" * 3000
    assert html_wrapper.infer([deep, deep, "<p>y</p>"])


def test_wrappers_follow_all_pages_of_a_host(spark):
    """Each page has a say in its host's wrapper, whatever their order and however few pages are alike."""
    odd = {5: "<hr>", 17: "<h2>Late news</h2><ul><li>a</li></ul>", 40: "<div class='menu'>m</div><blockquote>q</blockquote>", 61: "<table><tr><td>t</td></tr></table>"}
    said = {5: "", 17: "Late news\na\n", 40: "q\n", 61: "t\n"}
    rows = [(k, f"http://a.org/{k}", f"<body>{odd.get(k, '')}<p>Site name</p><div><p>text {k}</p></div></body>") for k in range(64)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(pages).collect()}
    assert got == {k: f"{said.get(k, '')}text {k}" for k in range(64)}
    found = {r["wrapper"] for df in (pages, pages.orderBy(F.desc("page_id")).repartition(7)) for r in html_wrapper.wrappers(df).collect()}
    assert len(found) == 1
    by_units = json.loads(html_wrapper.wrappers(pages, fan=2).first()["wrapper"])
    for wrapper in (json.loads(found.pop()), by_units):
        for _, _, text in rows:
            tokens = html_wrapper.stream(text)
            assert html_wrapper.along(wrapper, tokens, 0, {}, html_wrapper.places(tokens)) == (len(tokens), True)


def test_sketches_equal_grouped_pages():
    """Pages of equal tags share what was worked out, and each keeps its own texts."""
    rng, sketches = random.Random(3), html_wrapper.Sketches()
    for k in range(400):
        body = "".join(rng.choice(("<p>a%s</p>", "<ul><li>b%s<li>c</ul>", "<div>d%s<br>e</div>", "<nav>f%s", "</nav>", "<h1>g%s</h1>", "t%s", "</div>")).replace("%s", str(rng.randrange(3))) for _ in range(rng.randrange(7)))
        nodes = html_wrapper.grouped(html_wrapper.shaped(html_wrapper.stream(body)))
        shape, texts = html_wrapper.sketched(nodes)
        assert sketches.of(body) == (shape, [t if t is None else html_wrapper.digest(t) for t in texts])
    assert len(sketches.known) < 350
    assert html_wrapper.sketched(html_wrapper.unsketched(shape, texts)) == (shape, texts)


def test_a_text_takes_the_slot_of_its_place():
    """Where pages disagree on a slot's place, one page with damaged markup does not decide for the others."""
    wrapper = html_wrapper.aligned([["S", "lost", ""]], [["S", "one", "rest"]])
    assert [n[2] for n in wrapper] == ["", "rest"] and html_wrapper.main_text("two", wrapper) == "two"
    assert html_wrapper.main_text("two", wrapper[:1]) == ""


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700))
def test_ogg_round_trip(payload, packet):
    padded = ogg.pad(payload)
    media = ogg.write_ogg(padded, len(payload), packet=packet)
    found = ogg.read_samples(media)
    assert found["samples"] == padded and found["n_data"] == len(payload) and found["damaged"] == 0 and found["streams"] == 2
    assert found["duration_us"] == len(padded) * 1_000_000 // ogg.RATE and len(padded) % 64 == 0 and padded


def test_ogg_checksums_and_damage():
    crc = 0
    for byte in (data := bytes(range(200))):
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert ogg.page_checksum(data) == crc
    media = bytearray(ogg.write_ogg(bytes(200_000), 200_000))
    media[100_000] ^= 1
    streams, good, bad = ogg.read_ogg(bytes(media))
    assert bad == 1 and sum(s.gaps for s in streams.values()) == 1 and good >= 5


def test_media_columns(spark):
    df = clashing(frame(spark, ODD))
    rows = ogg.media_features(ogg.with_media(df)).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["n_bytes"]))
    texts = {hashlib.sha256(ogg.pad((t or "").encode())).hexdigest(): (t or "").encode() for _, t in ODD}
    assert len(rows) == len(ODD) and set(by) == set(texts) and all(len(v) == 1 for v in by.values())
    assert all(r["tail_crc32"] == zlib.crc32(ogg.pad(texts[r["payload_sha256"]])[-64:]) for r in rows)
