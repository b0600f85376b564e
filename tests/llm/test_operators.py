"""Each operator against a brute-force version, on odd rows and on no rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from compare import expected, rows_of
from tokenizers import Tokenizer

from statloom.llm import near_texts, op1_packing, op2_sharding, op3_html, op4_rules, op5_tokenfile, op6_bpe, op7_counts, op8_simhash, op9_ogg, op10_pii, queries
from statloom.llm.common import PIECE, PieceIds, pieces_of, shared_dir

WORD_BPE, BYTE_BPE, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def rows(df):
    return df.collect()


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def made_texts(n, seed, alphabet="aab é́ \n\t \x1c\x85'sßΣ1٣<|endoftext|>漢😀.,  theinger"):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pieces_give_the_tokenizers_ids(path):
    texts = made_texts(1500, 3)
    own, t = PieceIds(path, remembered=500), tokenizer(path)
    for at in range(0, 1500, 300):
        lot = texts[at : at + 300]
        assert [x.tolist() for x in own.encode_batch(lot)] == [x.ids for x in t.encode_batch(lot, add_special_tokens=False)]
    assert all(pieces_of(x) == PIECE.findall(x) for x in texts)


def test_packing(odd, no_rows):
    t, got = tokenizer(WORD_BPE), rows(op1_packing.packed(odd, WORD_BPE))
    ids = collections.defaultdict(list)
    for r in odd.collect():
        ids[r.doc_id].append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    pieces = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    for doc, copies in ids.items():
        own = [r for r in got if r.doc_id == doc]
        assert sum(r.length for r in own) == sum(map(len, copies))
        for start, length, crc, n in {(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own}:
            assert any(n == len(x) and crc == zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) for x in copies)
    assert pieces
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    groups = collections.defaultdict(dict)
    for r in got:
        groups[r.sequence_id >> 40, r.step_group][r.sequence_id] = r.context_size
    tokens = collections.defaultdict(list)
    for (part, _), sizes in sorted(groups.items()):
        tokens[part].append(sum(sizes.values()))
    assert all(x == op1_packing.STEP for own in tokens.values() for x in own[:-1]) and all(own[-1] <= op1_packing.STEP for own in tokens.values())
    assert rows(op1_packing.packed(no_rows, WORD_BPE)) == []


def test_packing_loses_nothing():
    draw = random.Random(4)
    for _ in range(200):
        pieces = [(draw.randint(1, 4096), k, 0) for k in range(draw.randint(0, 60))]
        want = {k: n for n, k, _ in pieces}
        windows, left = op1_packing.pack(list(pieces), last=True)
        assert not left
        spans = collections.defaultdict(list)
        for window in windows:
            for n, k, start in window:
                spans[k].append((start, n))
        for k, own in spans.items():
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
            assert at == want[k]


def test_sharding(odd, no_rows, spark):
    got = rows(op2_sharding.kd_shards(odd, 16))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and set(by_shard) <= set(range(16))
    assert rows(op2_sharding.kd_shards(no_rows, 16)) == []


@pytest.mark.parametrize("shards", [16, 5])
def test_sharding_is_even(spark, shards):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(20 + id % 50 as int)) as text", "if(id % 3 = 0, 's0', concat('s', id % 40)) as source", "'en' as lang")
    sizes = collections.Counter()
    for r in rows(op2_sharding.kd_shards(docs, shards)):
        sizes[r.shard] += r.size
    assert len(sizes) == shards
    mean = sum(sizes.values()) / shards
    assert all(abs(x - mean) < 0.02 * mean for x in sizes.values())


def test_sharding_follows_metadata(spark):
    """Equal texts in two sources: the source is split first, then the ids of each, as the source has no spread left."""
    docs = spark.range(2000).selectExpr("id as doc_id", "'some text' as text", "if(id % 2 = 0, 'https://a', 'https://b') as source", "'en' as lang")
    got = {r.doc_id: r.shard for r in rows(op2_sharding.kd_shards(docs, 4))}
    assert got == {k: 2 * (k % 2) + (k >= 1000) for k in range(2000)}


def test_html(spark, no_rows):
    tree = op3_html.train(spark)
    page = """<html><head><title>no</title><script>var t="</p>";</script></head><body><header>no <a href=/>no</a></header><nav><ul><li><a>no</a></li></ul></nav>
    <main><h1>A &amp; B</h1><p>One  two<br>three <b>four</b>
    five</p><div class="advert">no no</div><p>a < b &lt;c&gt;</p><aside>no</aside><form><p>no</p></form><div id="comments"><p>no no no no no no no no no no no no</p></div></main><footer>no</footer>"""
    assert op3_html.main_text(page, tree) == "A & B\nOne two three four five\na < b <c>"
    for broken in (None, "", "   ", "<", "<p", "<!-- x", "<a href='", "</p></p>", "<script>", "&#xZZ;&"):
        assert isinstance(op3_html.main_text(broken, tree), str)
    right = total = blind = 0
    densities = [k for k, x in enumerate(op3_html.FEATURES) if x.startswith("link_density")]
    for page, body in op3_html.labelled_pages(60, seed=99):  # pages that weren't trained on
        texts, features = op3_html.blocks(page)
        without = features.copy()
        without[:, densities] = 0
        for text, y, z in zip(texts, op3_html.predict(tree, features), op3_html.predict(tree, without)):
            total, right, blind = total + 1, right + ((y > 0.5) == (text in body)), blind + ((z > 0.5) == (text in body))
    assert right / total > 0.97 and blind / total < right / total - 0.05  # link densities matter
    # by hand: no name says what is what
    page = """<div><h1>Rain in the hills over the weekend</h1><p>Heavy rain fell in the hills on Saturday and the river rose by a metre before it went down again on Sunday.</p>
    <p><a href=/a>Sport</a> | <a href=/b>Weather</a> | <a href=/c>Politics</a></p><p>The road to the pass stays shut, <a href=/d>the county</a> said, and will open on Tuesday when the mud has gone from the bridge.</p></div>
    <div><ul><li><a href=/e>More on rain</a></li><li><a href=/f>More on hills</a></li></ul></div>"""
    assert [x.split()[0] for x in op3_html.main_text(page, tree).split("\n")] == ["Rain", "Heavy", "The"]
    pages = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (None, None, "<article><p>x y</p></article>", 4)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in rows(op3_html.extracted(pages))) == [("", 0), ("", 0), ("x y", 3)]
    assert rows(op3_html.extracted(pages.limit(0))) == []


SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = SPACES.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, no_rows, spark):
    got = rows(op4_rules.apply_policy(op4_rules.ledger(odd), "base-1"))
    want = collections.Counter((r.doc_id, *measures(r.text)) for r in odd.collect())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.kept == (r.n_words >= 10 and 100 * r.n_repeat_words <= 20 * r.n_words) for r in got)
    assert rows(op4_rules.ledger(no_rows)) == []
    table = op4_rules.ledger(odd)
    for r in rows(op4_rules.ablations(table, "web-2")):
        masks = [x.failed & op4_rules.POLICIES["web-2"] for x in got]
        assert (r.rejected, r.rejected_alone, r.kept_without) == (sum(bool(m & r.bit) for m in masks), sum(m == r.bit for m in masks), sum(not m & ~r.bit for m in masks))


def test_rules_sql(spark):
    assert rows_of(op4_rules.query(spark, SMALL).toPandas()) == expected(op4_rules.SQL, SMALL)
    assert rows_of(op4_rules.ablation_query(spark, SMALL).toPandas()) == expected(op4_rules.ABLATION_SQL, SMALL)


def test_token_files(odd, no_rows, spark):
    t = tokenizer(BYTE_BPE)
    folder = f"{shared_dir(spark)}/files-odd"
    op5_tokenfile.write_token_files(odd, folder, BYTE_BPE, 0, parts=3)
    got = sorted(rows(op5_tokenfile.read_token_files(spark, folder)), key=lambda r: r.start)
    want = odd.orderBy("doc_id", F.xxhash64("text")).collect()  # nulls first
    start = 0
    for r, w in zip(got, want, strict=True):
        ids = np.array(t.encode(w.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (w.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    op5_tokenfile.write_token_files(no_rows, folder + "-none", BYTE_BPE, 0, parts=2)
    assert rows(op5_tokenfile.read_token_files(spark, folder + "-none")) == []


def test_merge_replay(odd, no_rows):
    encoding = ranks()
    codec = op6_bpe.Codec(RANKS, P.PATTERN, remembered=300)
    texts = made_texts(1500, 5) + ["a" * 3000, "ab" * 900, "=-" * 700, " " * 300, "\n" * 40]
    for at in range(0, len(texts), 400):
        for text, (ids, decoded) in zip(texts[at : at + 400], codec.encode(texts[at : at + 400])):
            assert ids == " ".join(map(str, encoding.encode_ordinary(text))) and decoded == text.encode()
    for r in rows(op6_bpe.coded(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), RANKS, P.PATTERN)):
        text = odd.where(f"doc_id = {r.doc_id}").first().text or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(rows(op6_bpe.coded(odd, RANKS, P.PATTERN, digests=False))) == odd.count()
    assert rows(op6_bpe.coded(no_rows, RANKS, P.PATTERN)) == []


def test_edit_counts(odd, no_rows):
    encoding, counter = ranks(), op7_counts.Counter(RANKS, P.PATTERN, remembered=200)
    draw = random.Random(6)
    for text in made_texts(1200, 7):
        tree = op7_counts.SegmentTree(text, counter)
        places = sorted(draw.sample(range(len(text) + 1), min(len(text) + 1, 6) // 2 * 2))
        for a, b in reversed(list(zip(places[::2], places[1::2]))):
            new = draw.choice(["", " x", "the\n", "'s"])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
        assert (tree.text, tree.n_tokens, tree.n_chars) == (text, len(encoding.encode_ordinary(text)), len(text))
    text = " ".join(made_texts(400, 9))
    tree = op7_counts.SegmentTree(text, counter)
    for k in range(1000):  # beside each other
        at = 500 + 3 * k
        text = text[:at] + "ab c" + text[at + 1 :]
        tree.edit(at, at + 1, "ab c")
    assert tree.recounted < 12_000 and (tree.text, tree.n_tokens) == (text, len(encoding.encode_ordinary(text)))
    tree.edit(40, 40, " word" * 100_000)
    before = tree.recounted
    tree.edit(200_000, 200_001, "x")
    assert tree.recounted - before < 10 and tree.n_tokens == len(encoding.encode_ordinary(tree.text))
    tree.edit(0, tree.n_chars, "")
    tree.edit(0, 0, "new  ")
    assert (tree.text, tree.n_tokens) == ("new  ", len(encoding.encode_ordinary("new  ")))
    said = odd.limit(1).selectExpr("doc_id", "'abcdef' as text", "array(named_struct('start', 1, 'end', 5, 'text', 'X'), named_struct('start', 3, 'end', 4, 'text', 'Y'), named_struct('start', 6, 'end', 6, 'text', '1'), named_struct('start', 6, 'end', 6, 'text', '2')) as edits")
    assert rows(op7_counts.recounted(said, RANKS, P.PATTERN, with_text=True))[0].edited_text == "aXYef12"
    for r in rows(op7_counts.recounted(odd.withColumn("edits", F.expr(op7_counts.EDITS)), RANKS, P.PATTERN, with_text=True)):
        assert r.edited_tokens == len(encoding.encode_ordinary(r.edited_text)) and r.edited_chars == len(r.edited_text) and r.n_edits == 3
    none = odd.withColumn("edits", F.expr("cast(null as array<struct<start:int,end:int,text:string>>)"))
    assert all(r.edited_tokens == r.n_tokens for r in rows(op7_counts.recounted(none, RANKS, P.PATTERN)))
    assert rows(op7_counts.recounted(no_rows.withColumn("edits", F.expr(op7_counts.EDITS)), RANKS, P.PATTERN)) == []


def simhash(text):
    words = SPACES.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    names = list(items)
    label = {x: x for x in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if linked(items[a], items[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_simhash(odd, no_rows):
    known = odd.where("doc_id is not null")
    fps = {r.doc_id: simhash(r.text) for r in known.collect()}
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    got = rows(op8_simhash.near_duplicates(odd))
    assert len(got) == odd.count()
    assert all((r.fp % (1 << 64), r.component_id) == (fps[r.doc_id], want[r.doc_id]) for r in got if r.doc_id is not None)
    assert rows(op8_simhash.near_duplicates(no_rows)) == [] and rows(near_texts.near_texts(no_rows)) == []
    assert len(rows(near_texts.near_texts(odd))) == odd.count()


def test_near_texts_agree_with_all_pairs(spark, monkeypatch):
    """Groups of texts with 0.6 to 1 of their shingles in common, long buckets in tiles."""
    monkeypatch.setattr(near_texts, "TILE_SHINGLES", 500)
    monkeypatch.setattr(near_texts, "HUBS", 4)
    draw, texts = random.Random(11), []
    for group in range(12):
        words = [f"w{draw.randint(0, 4000)}" for _ in range(draw.randint(60, 300))]
        for _ in range(12):
            own = list(words)
            for at in draw.sample(range(len(own)), draw.randint(0, len(own) // 20)):
                own[at] = f"n{draw.randint(0, 10**6)}"
            texts.append(" ".join(own))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: set(near_texts.shingle_hashes(x).tolist()) for k, x in enumerate(texts)}
    want = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = {r.doc_id: r.component_id for r in rows(near_texts.near_texts(table))}
    assert len(set(want.values())) > 15 and got == want


@pytest.mark.parametrize("max_bits,blocks", [(3, 2), (5, 2), (4, 4)])
def test_anchors_lose_no_link(spark, max_bits, blocks, monkeypatch):
    monkeypatch.setattr(op8_simhash, "TILE", 16)
    draw = random.Random(max_bits)
    fps = [draw.getrandbits(64) for _ in range(60)]
    for x in list(fps):  # chains of near ones
        for _ in range(3):
            for b in draw.sample(range(64), draw.randint(1, max_bits + 1)):
                x ^= 1 << b
            fps.append(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in set(fps)]
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = {r.u: r.v for r in rows(op8_simhash.components(op8_simhash.links(table, max_bits, blocks)))}
    want = brute_components({x: x for x in fps}, lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= max_bits)
    assert {x: found.get(x, x) for x in fps} == want


def test_long_chain_of_links(spark):
    chain = spark.range(1, 200).selectExpr("id as u", "id - 1 as v")
    assert {r.v for r in rows(op8_simhash.components(chain))} == {0}


def test_ogg(odd, no_rows):
    got = rows(op9_ogg.decode(op9_ogg.encode(odd)))
    want = collections.Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want[r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert rows(op9_ogg.decode(op9_ogg.encode(no_rows))) == []
    long = op9_ogg.mux(*op9_ogg.payload_of("abc" * 90_000))
    flags = [long[m.start() + 5] for m in re.finditer(b"OggS", long)]
    assert sum(x & op9_ogg.CONTINUED for x in flags) == 3 and op9_ogg.read_back(long)[:2] == op9_ogg.payload_of("abc" * 90_000)
    stored = odd.sparkSession.createDataFrame([(1, None), (2, b""), (3, bytes(long[:-1])), (4, b"OggS"), (5, small := op9_ogg.mux(*op9_ogg.payload_of("a")))], "doc_id long, media binary")
    assert [(r.doc_id, r.n_bytes, r.media_bytes, (r.feature or "")[:8]) for r in sorted(rows(op9_ogg.decode(stored)))] == [(1, None, None, ""), (2, None, 0, "damaged:"), (3, None, len(long) - 1, "damaged:"), (4, None, 4, "damaged:"), (5, 1, len(small), "rate=800")]
    media = op9_ogg.mux(*op9_ogg.payload_of("abc" * 9000))
    crc = 0
    for byte in media[:22] + bytes(4) + media[26:28] + media[28 : 27 + media[26] + sum(media[27 : 27 + media[26]])]:  # bit by bit
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    assert crc == int.from_bytes(media[22:26], "little")
    for at in range(0, len(media), 997):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises((op9_ogg.Damaged, ValueError)):
            op9_ogg.read_back(bytes(broken))


PLAIN_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN_FORMS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x.lstrip("0")[:5] or 0) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and op10_pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], op10_pii.KINDS.index(s[1])))


def test_pii(odd, no_rows, spark):
    for text in made_texts(8000, 8, "ab1234567890@@..+- ()%é"):
        assert op10_pii.base_spans(text) == plain_spans(text)
    for r in rows(op10_pii.found(odd.where("doc_id is not null").dropDuplicates(["doc_id"]))):
        base = plain_spans(odd.where(f"doc_id = {r.doc_id}").first().text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in op10_pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(op10_pii.joined(base).encode()).hexdigest()
        assert {op10_pii.joined([s]) for s in base} <= set(r.spans.split(","))
    boosted, thresholds = op10_pii.train(spark)
    held = op10_pii.labelled_candidates(600, seed=123)  # rows of another seed
    scores = op10_pii.score(boosted, np.array([x for x, _, _ in held]))
    chosen = [(s >= thresholds[k], y) for s, (_, y, k) in zip(scores, held)]
    assert np.mean([y for c, y in chosen if c]) > 0.95 and np.mean([c for c, y in chosen if y]) > 0.8
    held_scores = sorted(set(scores.tolist()))
    assert all(min(held_scores) < t < max(held_scores) for t in thresholds.values()) and len(held_scores) > 50
    for said in ("06 12 34 56 78", "01.42.68.53.00", "0170 1234567", "030/123456", "91 123 45 67", "912 34 56 78", "0612345678", "5551234567", "555-1234", "0049 30 123456"):
        assert any(k == "phone" and f"tel {said} x"[a:b] == said for a, b, k in op10_pii.candidates(f"tel {said} x"))
    for said in ("jane Dot", "Jane.Roe (At) example Dot org", "jane @ example . org", "jane AT example [DOT] org"):
        assert any(k == "email" for _, _, k in op10_pii.candidates(f"write {said} now")) == ("ex" in said and " . " not in said)
    right = added = there = 0  # keys planted in the documents, which the plain forms don't have
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        text, base = r.text or "", op10_pii.base_spans(r.text or "")
        keys = {(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
        own = {(a, b) for a, k, b in op10_pii.all_spans(text, base, boosted, thresholds) if (a, k, b) not in base and k == "secret"}
        right, added, there = right + len(own & keys), added + len(own), there + len(keys)
    assert there > 5 and right >= 0.9 * there and right >= 0.9 * added
    text = "reach jane.roe (at) example (dot) org, card: 4111.1111.1111.1111 now"
    assert "example (dot) org" not in op10_pii.redact(text, op10_pii.all_spans(text, op10_pii.base_spans(text), boosted, thresholds))
    assert rows(op10_pii.found(no_rows)) == [] and rows(op10_pii.redacted(no_rows)) == []


def test_queries_give_their_columns(spark):
    names = {
        "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_kd_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op3_html_text": "page_id url text n_chars",
        "op4_rule_ledger": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_simhash_anchors": "doc_id fingerprint component_id",
    }
    for name, columns in names.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, SMALL).columns)
