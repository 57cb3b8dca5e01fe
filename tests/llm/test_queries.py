import collections
import hashlib
import html
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sigloom.llm import decontaminate, langid, near_dup, tokens, toxicity
from sigloom.llm.registry import QUERIES, SQL
from tests.llm.test_operators import brute_classes
from tests.oracle import canonical, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == sql_rows(SQL[name], sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_token_queries(spark, sf_dir, docs):
    ids = {i: np.frombuffer(x, "<u4") for (i, _), x in zip(docs, tokens.encode([t for _, t in docs], tokens.default_path()), strict=True)}
    at = 0
    for r in sorted(QUERIES["op3_repair_files"](spark, sf_dir).collect(), key=lambda r: r["doc_id"]):
        x = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    rows = QUERIES["op2_swap_packing"](spark, sf_dir).collect()
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == at and len({r["sequence_id"] for r in rows}) == -(-at // 4096)


def test_near_duplicate_query(spark, sf_dir, docs):
    want = brute_classes(spark, docs)
    texts = dict(docs)
    assert all(r["class_id"] == want[r["doc_id"], texts[r["doc_id"]]] for r in QUERIES["op4_weighted_minhash"](spark, sf_dir).collect())


def test_toxicity_query(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).score([t for _, t in docs])
    got = {r["doc_id"]: r for r in QUERIES["op1_boosted_toxicity"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for (i, _), s in zip(docs, want, strict=True):
        assert got[i]["score"] == pytest.approx(s) and got[i]["predicted"] == int(s >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [i for i in marked if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == marked[i] for i in held]) > 0.9


def test_language_query(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, scores = langid.fit(table).decide([t for _, t in docs])
    got = {r["doc_id"]: r for r in QUERIES["op7_string_kernel"](spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table.collect()}
    for (i, t), n, s in zip(docs, names, scores, strict=True):
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (n, zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["score"] == pytest.approx(s, abs=1e-4)
        assert langid.has_letter(t) or n == "und"
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in got if got[i]["held_out"] and truth[i]]) > 0.95


def test_sharding_query(spark, sf_dir, docs):
    loads, places, texts = collections.Counter(), collections.defaultdict(list), dict(docs)
    for r in QUERIES["op5_virtual_slots"](spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(loads) <= set(range(24)) and sum(map(len, places.values())) == len(docs)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_media_query(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in QUERIES["op10_ogg"](spark, sf_dir).collect()}
    by_text = collections.defaultdict(set)
    for i, t in docs:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_text[t or ""].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert len(got) == len(docs) and all(len(x) == 1 for x in by_text.values())


def test_page_query(spark, sf_dir):
    """The pages of this table have one article each, of headings and paragraphs: what an expression finds between its tags."""
    got = {r["page_id"]: r for r in QUERIES["op8_wrappers"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)[1]
        blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"<br>", " ", inside))
        want = "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))
    assert len(got) == len(rows)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """An empty table; null ids and texts, repeated rows and columns with clashing names through all stages."""
    labels, bench = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([("a", "b " * 12)], "item_id string, text string")
    for k, rows in enumerate(([], [(None, None), (1, None), (2, ""), (3, "some plain words that nobody minds at all"), (3, "some plain words that nobody minds at all"), (None, "no id here but words")])):
        d = f"{tmp_path}/{k}"
        docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, node string, lang_pred string")
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        assert len(got) <= len(rows) and {r["doc_id"] for r in got} <= {i for i, _ in rows}


def test_pipeline_stages_decide_as_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    assert ids(kept) == {r["doc_id"] for r, s in zip(rows, model.score([r["text"] for r in rows]), strict=True) if s < 0.5} and kept.columns == docs.columns
    kept = stages["language"](spark, docs, sf_dir)
    told = langid.identify(docs, langid.fit(docs), ["doc_id", "text"]).collect()
    want = {r["doc_id"] for r in told if langid.has_letter(r["text"]) and r["score"] >= 0.5}
    assert ids(kept) == want and kept.columns == docs.columns and len(want) > 0.98 * len(rows)
    junk = spark.createDataFrame([(1, "123 456 !!!"), (2, "x"), (3, "qzx jkv wqp zzk xvq jjw kqz")], "doc_id long, text string").join(docs.drop("doc_id", "text").limit(1))
    assert 1 not in ids(stages["language"](spark, docs.unionByName(junk.select(*docs.columns)).where("doc_id is not null"), sf_dir).where("text like '123 456%'"))
    kept = stages["near_duplicates"](spark, docs, sf_dir)
    assert ids(kept) == {r["class_id"] for r in near_dup.near_duplicates(docs).collect()} and kept.columns == docs.columns
    kept = stages["decontamination"](spark, docs, sf_dir)
    found = decontaminate.find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    assert ids(kept) == ids(found.where("n_hit = 0")) and kept.columns == docs.columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
