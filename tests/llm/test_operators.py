"""Every operator against a brute-force version, on odd rows and on empty tables."""

import hashlib
import heapq
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lintlake.llm.components import components
from lintlake.llm.decontaminate import clean_documents, contaminated_pairs
from lintlake.llm.fingerprints import closed_syncmers, code_points, decode, edit_probe, fingerprint, fingerprints, likeness
from lintlake.llm.jaccard_join import one_of_each, similar_documents
from lintlake.llm.lines import CuckooFilter, LineIndex, line_key, shard_of
from lintlake.llm.packing import pack_documents, plan_patterns
from lintlake.llm.sharding import byte_shards, write_shards
from lintlake.llm.shingles import shingle_hashes
from lintlake.llm.token_rollup import TokenRollup, deletes, inserts, revisions, token_counts
from lintlake.llm.tokens import ids_of
from lintlake.llm.toxicity import ToxicModel, learn, maximal_segments, score_documents, significant_features
from lintlake.llm.warc import derivatives, derive, responses_of_pages, split_response

from .conftest import ODD, prose


# 1 sharding

def test_shards(odd, docs_of):
    rows = byte_shards(odd, 4).collect()
    expected = sorted((-1 if i is None else 0, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    total, before, slots = sum(e[2] for e in expected), 0, Counter()
    wanted = []
    for null, i, size, crc in expected:
        shard = min((2 * before + size) * 4 // (2 * total), 3)
        wanted.append((None if null else i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows), key=key) == sorted(wanted, key=key)
    assert byte_shards(docs_of([]), 4).count() == 0


def test_shards_near_equal_under_skew(docs_of):
    rows = byte_shards(docs_of([(i, "x" * (2000 if i % 3 else 10)) for i in range(900)]), 7).collect()
    held = Counter()
    for r in rows:
        held[r.shard] += r["size"]
    assert max(held.values()) - min(held.values()) <= 2 * 2016 and len(held) == 7


def test_written_shards_hold_all_rows(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(50)])
    write_shards(docs, f"{tmp_path}/shards", 5)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 50 and {r.text for r in back.collect()} == {f"text {i}" for i in range(50)}


# 2 line dedup

def brute_lines(rows, min_docs, min_chars=40):
    held = defaultdict(set)
    at = lambda i: -(2**63) if i is None else i
    clean = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(clean(line)) >= min_chars:
                held[clean(line)].add(at(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[clean(x)]) < min_docs or at(i) == max(held[clean(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = [(i, "\n".join([f"own line of document {i} that is long enough to count", " \tA SHARED line that many documents have, over and over\r",
                        "short", "rare line that only four documents have in their text" if i < 4 else ""])) for i in range(30)]


def as_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_lines_and_odd_rows(spark, docs_of):
    rows = LINES + ODD + [(None, LINES[0][1]), (2, LINES[1][1])]
    found = LineIndex(spark).insert(docs_of(rows)).dedup(docs_of(rows))
    assert as_rows(found) == brute_lines(rows, 5)
    assert "clash" in found.columns or "part" in found.columns
    assert LineIndex(spark).insert(docs_of([])).dedup(docs_of([])).count() == 0


def test_lines_are_reversible(spark, docs_of):
    first, second = LINES[:18], LINES[18:]
    index = LineIndex(spark).insert(docs_of(first)).insert(docs_of(second))
    assert as_rows(index.dedup(docs_of(LINES))) == brute_lines(LINES, 5)
    index.insert(docs_of(first))  # once more: nothing is counted twice
    assert as_rows(index.dedup(docs_of(LINES))) == brute_lines(LINES, 5)
    index.delete(docs_of(second))
    assert as_rows(index.dedup(docs_of(first))) == brute_lines(first, 5)
    index.delete(docs_of(first[4:]))
    assert as_rows(index.dedup(docs_of(first[:4]))) == brute_lines(first[:4], 5)


def test_filters_are_asked_where_lines_are_read(spark, docs_of):
    keys = [line_key("x" * 40 + str(n)) for n in range(500)]
    rows = spark.createDataFrame([(k,) for k in keys], "key binary")
    for shards in (64, 7):
        found = {bytes(r[0]): r[1] for r in rows.selectExpr("key", f"pmod(xxhash64(key), {shards})").collect()}
        assert found == {k: shard_of(k, shards) for k in keys}
    # A task that holds two Python steps holds two workers: one step reads lines and asks, one rebuilds the texts.
    docs = docs_of(LINES)
    plan = LineIndex(spark).insert(docs).dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_lines_without_room_for_filters(spark, docs_of):
    index = LineIndex(spark, filter_bytes=0).insert(docs_of(LINES))
    assert as_rows(index.dedup(docs_of(LINES))) == brute_lines(LINES, 5)


def test_cuckoo_filter():
    keys = [line_key(f"{i:050d}") for i in range(6000)]
    held = CuckooFilter(4000)
    assert all(held.insert(k) for k in keys[:4000]) and held.contains(keys[:4000]).all()
    assert held.contains(keys[4000:]).mean() < 0.01
    for k in keys[:2000]:
        held.delete(k)
    assert held.contains(keys[2000:4000]).all() and held.contains(keys[:2000]).mean() < 0.01
    assert CuckooFilter.from_bytes(held.to_bytes()).contains(keys[2000:4000]).all()
    small = CuckooFilter(1)
    assert not all(small.insert(k) for k in keys[:500])


# 3 decontamination

def sets(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contamination_equals_exact_containment(spark, docs_of):
    items = [(n, prose(1000 + n, 8 + 6 * n)) for n in range(12)] + [(50, None), (51, ""), (52, "two words"), (None, prose(77, 30))]
    docs = [(n, prose(n, 3000) + " " + items[n % 12][1].upper() + ", " + prose(n + 500, 40)) for n in range(24)]
    docs += [(100, items[5][1][: len(items[5][1]) // 2]), (101, "Two, words!"), (102, prose(77, 30)), *ODD]
    words = items[11][1].split()
    docs += [(200 + k, prose(300 + k, 500) + " " + " ".join(words[:k * 6] + ["zzz"] + words[k * 6 + 1:])) for k in range(1, 11)]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contaminated_pairs(docs_of(docs), benchmark).collect()), key=str)
    exact = sorted(((d, i, len(sets(q)), len(sets(q) & sets(t))) for d, t in docs for i, q in items
                    if sets(q) and len(sets(q) & sets(t)) >= 0.8 * len(sets(q))), key=str)
    assert found == exact and len(found) >= 34
    # Each row is judged by its own text, also where ids repeat or are null.
    left = sorted(((r.doc_id, r.text) for r in clean_documents(docs_of(docs), benchmark).collect()), key=str)
    assert left == sorted(((d, t) for d, t in docs if not any(sets(q) and len(sets(q) & sets(t)) >= 0.8 * len(sets(q)) for _, q in items)), key=str)
    assert contaminated_pairs(docs_of([]), benchmark).count() == 0
    assert contaminated_pairs(docs_of(docs), benchmark.limit(0)).count() == 0


def test_items_of_one_or_two_shingles():
    from lintlake.llm.decontaminate import ItemBlock

    own = shingle_hashes(prose(5, 4000))
    for size in (1, 2):
        items = [own[n:n + size] for n in range(len(own) - size + 1)]
        found = ItemBlock(list(enumerate(items))).matches(own, 0.8)
        assert sorted(found) == [(n, size, size) for n in range(len(items))]


def test_benchmark_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr("lintlake.llm.decontaminate.BLOCK_SHINGLES", 40)
    benchmark = spark.createDataFrame([(n, prose(n, 30)) for n in range(8)], "item_id long, text string")
    docs = docs_of([(n, prose(99, 200) + " " + prose(n, 30)) for n in range(8)])
    assert sorted((r.doc_id, r.item_id) for r in contaminated_pairs(docs, benchmark).collect()) == [(n, n) for n in range(8)]


# 4 fingerprints

def test_syncmers_are_context_free():
    text = prose(3, 400)
    at, values = closed_syncmers(code_points(text))
    shifted, again = closed_syncmers(code_points("some words before " + text))
    inside = shifted >= 18
    assert len(at) > 100 and (shifted[inside] - 18 == at).all() and (again[inside] == values).all()
    for k, s in ((8, 4), (11, 4), (16, 7)):  # against the definition
        points = code_points(text[:300])
        from lintlake.llm.fingerprints import _grams
        inner = _grams(points, s)
        wanted = [i for i in range(len(points) - k + 1) if min(inner[i:i + k - s + 1]) in (inner[i], inner[i + k - s])]
        assert closed_syncmers(points, k, s)[0].tolist() == wanted


def brute_probe(rows):
    null = -(2**63)
    tie = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True)
    ordered = sorted(rows, key=lambda r: (-(null if r[0] is None else r[0]), tie(r[1])))
    out = []
    for n, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(n + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        own, changed = decode(fingerprint(t)), decode(fingerprint(edited))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited),
                    round(likeness(own, changed), 9), round(likeness(own, decode(fingerprint(after))), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edit_probe(docs_of, buckets):
    rows = ODD + [(1000 + n, prose(n, n)) for n in range(60)]
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
             for r in edit_probe(docs_of(rows), buckets).collect()]
    assert sorted(found, key=str) == brute_probe(rows)


def test_fingerprints_of_odd_rows(odd, docs_of):
    assert sorted(((r.doc_id, r.fingerprint) for r in fingerprints(odd).collect()), key=str) == sorted(((i, fingerprint(t)) for i, t in ODD), key=str)
    assert edit_probe(docs_of([])).count() == 0
    one = edit_probe(docs_of([(4, prose(1, 80))])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_likeness_tells_edits_from_neighbours(docs_of):
    rows = edit_probe(docs_of([(n, prose(n, 200)) for n in range(40)])).collect()
    assert all(r.near_edited > 0.15 > r.near_next for r in rows)


# 5 token counts

def test_rollup_equals_recount(spark, docs_of, odd):
    counts = token_counts(odd, ("byte_bpe_50k", "byte_bpe_multi_50k")).cache()
    assert counts.count() == 2 * len(ODD)
    rollup = TokenRollup(spark)
    assert rollup.totals().count() == 0
    gone = counts.where("doc_id = 7")
    assert rollup.commit("a", inserts(counts.selectExpr("*", "1L as t").drop("tokens").withColumnRenamed("t", "tokens")))
    assert rollup.commit("b", revisions(counts.selectExpr("*", "1L as was")))
    assert rollup.commit("c", deletes(gone))
    assert not rollup.commit("b", revisions(counts.selectExpr("*", "1L as was")))  # again: no change
    again = TokenRollup(spark, rollup.path)
    found = {r.version: (r.docs, r.tokens) for r in again.totals().collect()}
    expected = sum(len(ids_of(t)) for i, t in ODD if i != 7)
    assert found["byte_bpe_50k"] == (len(ODD) - 1, expected) and set(found) == {"byte_bpe_50k", "byte_bpe_multi_50k"}
    assert rollup.commit("d", deletes(counts.where("doc_id is null or doc_id <> 7")))
    assert rollup.totals().count() == 0
    assert token_counts(docs_of([])).count() == 0


def test_failed_batch_is_not_counted(spark, odd):
    rollup = TokenRollup(spark)
    counts = token_counts(odd)
    rollup.commit("a", inserts(counts))
    before = rollup.totals().collect()
    spark.range(3).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{rollup.path}/deltas/batch=b")
    assert rollup.totals().collect() == before and rollup.commit("b", inserts(counts))


def test_ids_equal_the_tokenizer():
    import public_tokenizers

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reader.encode_special_tokens = True
    for text in [t or "" for _, t in ODD] + ["a  b   c\n \n x", "it's 12345 ﷺ x", " \t lead"]:
        assert ids_of(text).tolist() == reader.encode(text, add_special_tokens=False).ids


# 6 WARC

def test_warc_records_are_linked(spark):
    rows = [(1, "http://a/", "<html><body><nav>menu</nav><p>caf&eacute; &amp; tea</p><script>x</script></body></html>"), (2, None, None), (None, "http://b/", ""),
            (3, "http://c/", "<p>" + "word " * 50_000), (3, "http://c/", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")
    responses = responses_of_pages(pages, "2024-01-01T00:00:00Z")
    source = {r.record_id: r for r in responses.collect()}
    records = derivatives(responses).collect()
    assert Counter(r.record_type for r in records) == {"metadata": 5, "conversion": 5}
    for r in records:
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = body[:-4]
        assert head.startswith(b"WARC/1.1\r\n") and bytes(r.record).endswith(b"\r\n\r\n")
        assert lines["WARC-Refers-To"] == r.refers_to and r.refers_to in source and lines["WARC-Record-ID"] == r.record_id != r.refers_to
        assert int(lines["Content-Length"]) == len(body) == r.content_length
        assert lines["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(body).hexdigest()}" == r.block_digest
        _, _, payload = split_response(bytes(source[r.refers_to].block))
        assert r.source_digest == f"sha256:{hashlib.sha256(payload).hexdigest()}"
        assert lines.get("WARC-Target-URI") == r.target_uri
        if r.record_type == "metadata":
            assert b"source-header-content-type: text/html; charset=utf-8" in body and r.source_digest.encode() in body
    texts = {r.source_id: bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4].decode() for r in records if r.record_type == "conversion"}
    assert texts["1"] == "menu\ncafé & tea" and texts["2"] == "" and len(texts["3"]) == 249_999
    assert derivatives(responses.limit(0)).count() == 0


def test_warc_other_payloads(spark):
    block = lambda kind, body: f"HTTP/1.1 404 Not Found\r\nContent-Type: {kind}\r\nX-A: 1\r\n\tfolded\r\n\r\n".encode() + body
    rows = [("i", "<urn:uuid:1>", "u", "d", block("image/png", b"\x89PNG")), ("t", "<urn:uuid:2>", "u", "d", block("text/plain; charset=latin-1", "é".encode("latin-1"))),
            ("x", "<urn:uuid:3>", "u", "d", block("text/html; charset=nonsense", b"<p>hi")), ("n", "<urn:uuid:4>", "u", "d", None), ("r", "<urn:uuid:5>", "u", "d", b"no http here")]
    made = derivatives(spark.createDataFrame(rows, "source_id string, record_id string, target_uri string, warc_date string, block binary")).collect()
    kinds = Counter((r.source_id, r.record_type) for r in made)
    assert kinds[("i", "metadata")] == 1 and ("i", "conversion") not in kinds
    assert b"x-a: 1 folded" in next(bytes(r.record) for r in made if r.source_id == "i").lower()
    assert next(bytes(r.record) for r in made if r.source_id == "t" and r.record_type == "conversion").endswith("é\r\n\r\n".encode())


@pytest.mark.parametrize("charset", ["idna", "undefined", "utf-7", "unicode_escape", "punycode", "utf-16", "hex", "mbcs", "latin-1", "x" * 5000])
def test_warc_hostile_charsets(charset):
    for body in (b"<p>a\\ud800 &#xD800; +2AA- \xff\xfe</p>", b"", b"\x00" * 9):
        records = derive("s", "<urn:uuid:1>", "http://a/\ud800", "d", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + body, {})
        assert [r[1] for r in records] == ["metadata", "conversion"] and all(isinstance(r[-1], bytes) for r in records)


def test_warc_encoded_payloads(spark):
    page = ("<p>" + "plain words " * 400 + "</p>").encode()
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(page[n:n + 1000]), page[n:n + 1000]) for n in range(0, len(page), 1000)) + b"0\r\n\r\n"
    packed = zlib.compressobj(wbits=31)
    gzipped = packed.compress(page) + packed.flush()
    head = lambda extra: f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{extra}\r\n\r\n".encode()
    blocks = {
        "chunked": head("Transfer-Encoding: chunked") + chunked, "gzip": head("Content-Encoding: gzip") + gzipped,
        "both": head("Content-Encoding: x-gzip\r\nTransfer-Encoding: chunked") + b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzipped), gzipped),
        "deflate": head("Content-Encoding: deflate") + zlib.compress(page), "raw": head("Content-Encoding: deflate") + zlib.compress(page)[2:-4],
        "broken": head("Content-Encoding: gzip") + b"not gzip", "unknown": head("Content-Encoding: zz") + page, "torn": head("Transfer-Encoding: chunked") + b"zz\r\n",
    }
    rows = spark.createDataFrame([(k, f"<urn:uuid:{k}>", "u", "d", b, f"sha1:{k}", None) for k, b in blocks.items()],
                                 "source_id string, record_id string, target_uri string, warc_date string, block binary, payload_digest string, block_digest string")
    made = derivatives(rows).collect()
    texts = {r.source_id: bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4].decode() for r in made if r.record_type == "conversion"}
    assert set(texts) == {"chunked", "gzip", "both", "deflate", "raw"} and set(texts.values()) == {("plain words " * 400).strip()}
    meta = {r.source_id: bytes(r.record).decode() for r in made if r.record_type == "metadata"}
    assert len(meta) == len(blocks) and all(f"source-record-payload-digest: sha1:{k}\r\n" in v and "record-block-digest" not in v for k, v in meta.items())


# 8 packing

def test_packing_is_whole_and_gapless(odd, docs_of):
    rows = pack_documents(odd).collect()
    wanted = Counter()
    for i, t in ODD:
        ids = np.append(ids_of(t), np.uint32(1)).astype("<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start:start + 2048]
            wanted[(i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    packs = defaultdict(list)
    for r in rows:
        packs[r.sequence_id].append((r.offset, r.length))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(packs) == list(range(len(packs)))
    assert pack_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 5000) if seed % 2 else np.minimum(rng.geometric(0.05, 5000), 100)
    patterns = plan_patterns(dict(Counter(lengths.tolist())), 100)
    placed = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= 100
        for length in pattern:
            placed[length] += count
    assert placed == Counter(lengths.tolist()) and len(patterns) <= 2 * len(placed)
    packs, least = sum(c for c, _ in patterns), lengths.sum() / 100
    assert packs <= max(least * 1.1 + 1, (lengths > 50).sum() + 1 + least * 0.2)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_pack_like_one_by_one(seed):
    """The plan over counts needs no more packs than placing document by document on the shortest pack, give or take one in a hundred."""
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 101, 1500), rng.choice([30, 50, 70, 100], 500 * (seed % 3))]).tolist()
    packs: list[int] = []
    for length in sorted(lengths, reverse=True):
        if packs and packs[0] + length <= 100:
            heapq.heapreplace(packs, packs[0] + length)
        else:
            heapq.heappush(packs, length)
    planned = sum(count for count, _ in plan_patterns(dict(Counter(lengths)), 100))
    assert planned <= len(packs) * 1.01 + 1


# 9 toxicity

def toxic_docs(n, start=0):
    return [(start + i, prose(i + start, 120) + (" grumpf zorkel vile" if i % 5 == 0 else "") + " " + prose(i + 9000 + start, 60)) for i in range(n)]


def test_toxic_passages(spark, docs_of):
    rows = toxic_docs(400)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i, _ in rows] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = learn(docs_of(rows), labels)
    found = {r.doc_id: r for r in score_documents(docs_of(toxic_docs(200, 5000)), model).collect()}
    assert all(r.predicted == (i % 5 == 0) for i, r in found.items())
    hit = found[5000]
    assert any(p["first"] <= 120 < p["end"] for p in hit.passages) and hit.score > 0.5 > found[5001].score
    odd_rows = score_documents(docs_of(ODD), model).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r.score <= 1 for r in odd_rows)
    assert score_documents(docs_of([]), model).count() == 0


def test_features_and_scores_by_definition(spark, docs_of):
    """Log-odds counted word by word, and every score from segments found by trying all."""
    rows = [(i, t) for i, t in toxic_docs(160)]
    labelled = [(i, t, int(i % 5 == 0)) for i, t in rows]
    weights = significant_features(spark.createDataFrame(labelled, "doc_id long, text string, toxic int"))
    having = {0: Counter(), 1: Counter()}
    for _, text, toxic in labelled:
        words = set(re.findall(r"\w+", text.lower()))
        having[toxic].update({w + "$" for w in words} | {w[:n] for w in words for n in (3, 4, 5, 6) if len(w) >= n})
    share = sum(t for *_, t in labelled) / len(labelled)
    expected = {}
    for name in having[0].keys() | having[1].keys():
        toxic, clean = having[1][name] + 4 * share, having[0][name] + 4 * (1 - share)
        weight = math.log(toxic) - math.log(clean) - math.log(share / (1 - share))
        if abs(weight) >= 3.5 * math.sqrt(1 / toxic + 1 / clean):
            expected[name] = pytest.approx(weight)
    assert expected and weights == expected
    model = ToxicModel(weights, 0.5, 0.8, -1.0, (0.7, 0.4, -1.5), 0.0)
    texts = [(i, t[:120] + " grumpf" * (i % 3) + (" zorkel vile" if i % 4 == 0 else "")) for i, t in toxic_docs(24, 700)] + [(1, ""), (2, None)]
    got = {r.doc_id: r for r in score_documents(docs_of(texts), model).collect()}
    for i, text in texts:
        words, values = re.findall(r"\w+", (text or "").lower()), []
        for at, word in enumerate(words):
            known = [weights[k] for k in (word + "$", *(word[:n] for n in (6, 5, 4, 3) if len(word) >= n)) if k in weights]
            value = (known[0] if known else 0.0) - 0.5
            values.append(-0.5 if value > 0 and at and words[at - 1] == word else value)
        chance = math.log(max(len(words), 1)) - 1.0
        over = [0.8 * sc - chance for _, _, sc in brute_segments(values, 0, len(values))]
        x = 0.7 * max(over, default=-chance) + 0.4 * math.log1p(sum(o for o in over if o > 0)) - 1.5
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-x))) and got[i].predicted == int(got[i].score >= 0.5)
        assert sorted(p["excess"] for p in got[i].passages) == pytest.approx(sorted(o for o in over if o > 0))


def test_nothing_to_learn(spark, docs_of, odd):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        rows = score_documents(odd, learn(odd, some)).collect()
        assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)


@pytest.mark.parametrize("pattern", [[1.0, -2.0], [1.0, -0.5], [2.0, -1.0, 1.0, -3.0]])
def test_segments_of_very_long_texts(pattern):
    """500,000 words take seconds whichever way the total moves; the best segment is the one of Kadane's scan."""
    scores = np.array(pattern * (500_000 // len(pattern)))
    start = time.perf_counter()
    found = maximal_segments(scores)
    assert time.perf_counter() - start < 10
    best = now = 0.0
    for x in scores.tolist():
        now = max(0.0, now + x)
        best = max(best, now)
    assert max(s for _, _, s in found) == pytest.approx(best)


def brute_segments(scores, low, high):
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
    return [] if best[0] <= 0 else [*brute_segments(scores, low, best[3]), (best[3], best[4], best[0]), *brute_segments(scores, best[4], high)]


def test_maximal_segments_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = rng.normal(-0.2, 1, 14)
        assert [(a, b, pytest.approx(s)) for a, b, s in brute_segments(scores.tolist(), 0, 14)] == maximal_segments(scores)


# 10 Jaccard join

def brute_join(rows):
    ids, shingled = [i for i, _ in rows], [sets(t) for _, t in rows]
    above = list(range(len(rows)))

    def find(a):
        while above[a] != a:
            a = above[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = shingled[a], shingled[b]
            if x == y or x and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                above[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), ids[a]), ids[a])
    return sorted((ids[a], least[find(a)], links[a]) for a in range(len(rows)))


def test_join_finds_the_links_of_the_given_documents(spark):
    """Every link between whole texts of the table, found by counting shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shingled = {r.doc_id: sets(r.text) for r in docs.select("doc_id", "text").collect()}
    having = defaultdict(list)
    for i, found in shingled.items():
        for shingle in found:
            having[shingle].append(i)
    links = {}
    for i, found in shingled.items():
        shared = Counter(j for shingle in found for j in having[shingle])
        links[i] = sum(5 * n >= 4 * (len(found) + len(shingled[j]) - n) for j, n in shared.items() if j != i)
    assert sum(links.values()) and {r.doc_id: r.n_links for r in similar_documents(docs).collect()} == links


def near(seed, n, words=120, edits=2):
    base = prose(seed, words).split()
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, words, edits):
            w[at] = f"edit{k}"
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(docs_of):
    texts = [t for s in range(12) for t in near(s, 12)] + [prose(s, 150) for s in range(100, 160)] + [prose(50, 90)] * 30 + ["", None, "...", "a b", "A, b", "a c"]
    rows = list(enumerate(texts)) + [(9000, prose(4, 20_000)), (9001, prose(4, 20_000) + " more"), (-3, texts[0])]
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs_of(rows)).collect())
    assert found == brute_join(rows)
    kept = {r.doc_id for r in one_of_each(docs_of([*rows, (None, "x")])).collect()}
    assert kept == {c for _, c, _ in found} | {None}


def test_join_of_a_large_dense_group(docs_of, monkeypatch):
    monkeypatch.setattr("lintlake.llm.jaccard_join.SMALL", 20)
    monkeypatch.setattr("lintlake.llm.jaccard_join.BLOCK", 30)
    monkeypatch.setattr("lintlake.llm.jaccard_join.BLOCK_SHINGLES", 4000)
    rows = list(enumerate(near(3, 150, edits=4) + near(4, 60, edits=3)))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs_of(rows)).collect()) == brute_join(rows)


def test_join_of_many_short_near_copies(docs_of, monkeypatch):
    """Blocks of a component are bounded by members too, however few shingles these have."""
    from lintlake.llm import jaccard_join

    grouped, largest = jaccard_join._by_group, []

    def recorded(rows, keys, *rest):
        if keys[0] == "component":
            largest.append(max(r["count"] for r in rows.groupBy(*keys).count().collect()))
        return grouped(rows, keys, *rest)

    monkeypatch.setattr(jaccard_join, "_by_group", recorded)
    monkeypatch.setattr(jaccard_join, "BLOCK", 30)
    rows = [(n, f"{prose(8, 23)} last{n % 190}") for n in range(200)] + [(500 + n, prose(900 + n, 24)) for n in range(5)]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs_of(rows)).collect()) == brute_join(rows)
    assert len(largest) == 1 and largest[0] <= 120


def test_links_of_a_group_in_slices(monkeypatch):
    import pyarrow as pa

    from lintlake.llm import jaccard_join

    texts = near(5, 40, edits=5) + [prose(5, 120)]
    shingled = [sorted(set(shingle_hashes(t).view(np.int64).tolist())) for t in texts]
    whole = []
    for size in (1000, 7):
        monkeypatch.setattr(jaccard_join, "BLOCK", size)
        for sides in ([0] * 41, [n % 2 for n in range(41)]):
            group = pa.table({"rep": range(41), "copies": [1 + n % 3 for n in range(41)], "first": range(41), "alone": [not any(sides)] * 41,
                              "side": sides, "i": [0] * 41, "j": [max(sides)] * 41, "shingles": pa.array(shingled, pa.list_(pa.int64()))})
            whole.append(jaccard_join._links(group, jaccard_join.Forest(), 0.8))
            x = [set(s) for s in shingled]
            close = lambda a, b: a != b and (not any(sides) or sides[a] != sides[b]) and len(x[a] & x[b]) >= 0.8 * len(x[a] | x[b])
            wanted = {a: sum(1 + b % 3 for b in range(41) if close(a, b)) for a in range(41)}
            assert {r[0]: r[1] for r in whole[-1]} == {a: n for a, n in wanted.items() if n} != {}
    assert whole[:2] == whole[2:]


def test_pairs_of_blocks(spark, monkeypatch):
    """Both orders of a cross pair are joined whatever the sizes, and a pair with an empty block has no links."""
    import pyarrow as pa

    from lintlake.llm import jaccard_join

    handles = []

    def caught(rows, keys, handle, fields, ddl):
        handles.append(handle)
        return spark.createDataFrame([], ddl)

    monkeypatch.setattr(jaccard_join, "_by_group", caught)
    reps = spark.createDataFrame([(n, 9, bytes(256), bytes(64)) for n in range(2)], "rep long, size long, sketch binary, short binary")
    jaccard_join.candidate_edges(reps, 0.8, 1)
    forest = jaccard_join.Forest()
    handles[0](pa.table({"rep": [7, 8, 1, 2], "size": [9] * 4, "short": [bytes([n] * 64) for n in (1, 2, 1, 2)], "side": [0, 0, 1, 1], "i": [0] * 4, "j": [1] * 4}), forest)
    assert sorted(forest.edges()) == [(7, 1), (8, 2)]
    group = pa.table({"rep": [1, 2], "copies": [1, 1], "first": [1, 2], "alone": [False] * 2, "side": [0, 0], "i": [0, 0], "j": [1, 1],
                      "shingles": pa.array([[5, 6], [5, 6]], pa.list_(pa.int64()))})
    assert jaccard_join._links(group, jaccard_join.Forest(), 0.8) == []


def test_join_of_texts_of_one_shingle(docs_of):
    rows = list(enumerate(["ha " * 6, "ha " * 9, "Ha, " * 9, "ha " * 4, "ha " * 30, "one two three four five", "one two three four six", "a b", "b a"]))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in similar_documents(docs_of(rows)).collect()) == brute_join(rows)


def test_join_of_odd_rows(docs_of):
    rows = similar_documents(docs_of(ODD)).collect()
    assert len(rows) == sum(i is not None for i, _ in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[11].class_id == by_id[12].class_id == -4 and by_id[3].class_id == by_id[2].class_id == 2
    assert similar_documents(docs_of([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.rep: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles():
    assert len(shingle_hashes(None)) == 0 and len(shingle_hashes("One, two")) == 1
    assert (shingle_hashes("a b c d e f") == shingle_hashes("A b! c d\ne F")).all() and len(shingle_hashes("a b c d e f")) == 2
    assert shingle_hashes("b a")[0] != shingle_hashes("a b")[0]
