"""Text operators against the libraries, brute force and their own round trips, on small tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from synchra.llm import fingerprint, jaccard, langid, lmscore, ogg, packing, quality, sstable, substring_dedup, transducer
from synchra.llm.queries import vocabulary
from synchra.llm.suffixarray import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "land", "river", "stone", "über", "niño", "walk", "blue", "seven", "quick", "ate"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, nulls, empty, blank, very long and odd texts; ids aren't contiguous."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 200)) for _ in range(24)]
    passage = words(rng, 40)
    near = base[3].split()
    near[10] = "changed"
    out = [*base, base[0], base[0], " ".join(near), base[1] + " " + passage, words(rng, 30) + passage + base[4], passage, None, "", " \n\t", "漢字 ΑΣ İx", "<|endoftext|> a<|startoftext|>", "a" * 3000, "one two", words(rng, 4000), base[5] + " end", "x  y\n\n z\r\n\x00é", "ß" * 70, "ß" * 70, "!" * 200 + "1234567"]
    return {10 * i + 3: t for i, t in enumerate(out)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][k % 3], "s", len(t or "")) for k, (i, t) in enumerate(texts.items())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def edge_cases(spark, operator):
    """A null id and repeated rows are kept; extra columns don't matter."""
    odd = spark.createDataFrame([(None, "a b c d e f", 1, "k"), (7, "some text here", 2, "k"), (7, "some text here", 2, "k"), (8, None, 3, "k")], "doc_id long, text string, score int, fingerprint string")
    got = operator(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 7), (False, 7), (False, 8), (True, 0)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")}


def pack32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_fingerprints(spark, docs, texts, empty):
    got, ids = rows(fingerprint.fingerprints(docs)), sorted(texts)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, nxt = texts[a] or "", texts[b] or ""
        changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[a].n_chars == len(t) and got[a].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[a].near_next == pytest.approx(fingerprint.Sketch.parse(got[a].fingerprint).likeness(fingerprint.Sketch.parse(got[b].fingerprint)))
        if changed == t:
            assert got[a].near_edited == 1
    same = [i for i in ids if texts[i] == texts[3]]
    assert len({got[i].fingerprint for i in same}) == 1 and len(same) == 3
    assert fingerprint.fingerprints(empty).count() == 0
    edge_cases(spark, fingerprint.fingerprints)
    one = fingerprint.fingerprints(docs.where("doc_id = 3")).first()
    assert one.near_next == 1


def test_fingerprints_over_many_ranges(docs, texts):
    ids = sorted(texts)
    from synchra.llm.fingerprint import with_next

    seen = collections.defaultdict(list)
    for r in with_next(docs, 2000).collect():
        seen[r.part].append((r.own, r.doc_id))
    assert len(seen) > 3
    assert sorted(i for p in seen.values() for own, i in p if own) == ids
    for p in seen.values():
        last = max(i for own, i in p if own)
        follow = [i for own, i in p if not own]
        assert follow == [ids[(ids.index(last) + 1) % len(ids)]]


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[::4], rng.integers(0, (1 << 64) - 1, 2_000, np.uint64)]))
    sa, sb = fingerprint.Sketch.of(np.sort(a)), fingerprint.Sketch.of(b)
    assert sa.containment(sb) == pytest.approx(0.25, abs=0.02) and sb.containment(sa) == pytest.approx(10 / 12, abs=0.1)
    assert fingerprint.Sketch.parse(str(sa)).likeness(sa) == 1


def test_merged_sketches_are_those_of_the_union():
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 3), (1, 1), (1, 2), (2, 5), (40, 1), (300, 200)] * 20:
        a, b = (np.unique(rng.integers(0, (1 << 64) - 1, k, np.uint64)) for k in (n, m))
        sa, sb, both = fingerprint.Sketch.of(a), fingerprint.Sketch.of(b), fingerprint.Sketch.of(np.union1d(a, b))
        assert str(sa.merge(sb)) == str(both) == str(sb.merge(sa))
        assert str(sa.merge(sa)) == str(sa) == str(sa.merge(fingerprint.Sketch.of(a[:0])))
        assert sa.merge(sa).likeness(sb.merge(sb)) == (1.0 if not n and not m else 0.0)
        assert (str(sa) == str(sb)) == (n == m == 0)


def test_likeness_against_exact_jaccard(spark):
    """End to end: likeness and containment near the exact ones, over documents with many shingles."""
    raw = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 3000").collect()}
    got = rows(fingerprint.fingerprints(spark.createDataFrame(list(raw.items()), "doc_id long, text string")))
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    ids, off = sorted(raw), []
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        x, y = grams(raw[a]), grams(raw[b])
        e = grams(fingerprint.edited(raw[a], raw[b]))
        off += [got[a].near_edited - len(x & e) / len(x | e), got[a].near_next - len(x & y) / len(x | y)]
        off += [got[a].holds_edited - len(x & e) / len(e), got[a].held_by_next - len(x & y) / len(x)]
    assert len(ids) > 20 and np.abs(off).max() < 0.15 and abs(np.mean(off)) < 0.01


def test_ranges_split_an_id_with_many_rows(spark):
    """Null and hot ids are dealt over ranges, and rows still follow each other in one order."""
    data = [(i, f"{i} {k} " + "word " * 30) for i in (None, 5, 6) for k in range(40 if i != 6 else 1)] + [(6, "same text")] * 4
    d = spark.createDataFrame(data, "doc_id long, text string")
    parts = collections.defaultdict(set)
    for r in fingerprint.with_next(d, 600).collect():
        if r.own:
            parts[r.doc_id].add(r.part)
    assert len(parts[None]) > 5 and len(parts[5]) > 5
    assert len(fingerprint.fingerprints(d).collect()) == len(data)


def test_shards(spark, docs, texts, empty, library, tmp_path):
    path, lib = vocabulary("byte_bpe_50k.json"), library["byte_bpe_50k"]
    got, at = rows(sstable.token_table(docs, path)), 0
    want = {}
    for i in sorted(texts):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want[i] = pack32(ids)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(want[i]))
        at += len(ids)
    manifest = [r.asDict() for r in sstable.write_shards(docs, path, f"file://{tmp_path}/s", text_per_shard=4000).orderBy("first").collect()]
    assert len(manifest) > 2 and all(a["last"] < b["first"] for a, b in zip(manifest, manifest[1:], strict=False))
    misses = 0
    for m in manifest:
        shard = sstable.open_shard(m["uri"])
        inside = [i for i in want if m["first"] <= i <= m["last"]]
        assert all(shard.get(i) == [want[i]] for i in inside)
        assert not any(shard.get(i) for i in want if i not in inside)
        misses += sum(map(shard.may_hold, range(100_000, 100_200)))
    assert misses <= 20 * len(manifest)
    assert sstable.token_table(empty, path).count() == 0
    edge_cases(spark, lambda d: sstable.token_table(d, path))
    many = spark.createDataFrame([(i, f"text {k} " * 20) for k in range(60) for i in (None, 7, -(1 << 63))], "doc_id long, text string")
    shards = sstable.write_shards(many, path, f"file://{tmp_path}/t", text_per_shard=1000)
    assert shards.where("first = 7 and last = 7").count() > 1
    got, at = sorted(sstable.token_table(many, path).collect(), key=lambda r: r.start), 0
    assert [r.doc_id for r in got] == [None] * 60 + [-(1 << 63)] * 60 + [7] * 60
    for r in got:
        assert r.start == at
        at += r.n_tokens
    back = sstable.read_shards(shards).collect()
    assert collections.Counter((r.doc_id, zlib.crc32(r.ids)) for r in back) == collections.Counter((r.doc_id, r.ids_crc32) for r in got)


def test_a_damaged_block_is_noticed(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = sstable.ShardWriter(f, 2, block=64)
        for i in (-5, -5, 0, 1, 256, 1 << 40):
            w.add(i, pack32([1, 2, 3] * 5))
        with pytest.raises(ValueError):
            w.add(0, b"")
        w.finish()
    raw = bytearray((tmp_path / "x").read_bytes())
    shard = sstable.open_shard(f"file://{tmp_path}/x")
    assert len(shard.get(-5)) == 2 and shard.get(1 << 40) == [pack32([1, 2, 3] * 5)] and shard.get(2) == []
    raw[3] ^= 1
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        sstable.open_shard(f"file://{tmp_path}/x").get(-5)


def test_transducer(spark, docs, texts, empty, library):
    path, lib = vocabulary("word_bpe_49k.json"), library["word_bpe_49k"]
    got = rows(transducer.encode_decode(docs, path))
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(pack32(ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert transducer.encode_decode(empty, path).count() == 0
    edge_cases(spark, lambda d: transducer.encode_decode(d, path))


def small_transducer(merges):
    t = transducer.Transducer.__new__(transducer.Transducer)
    t.ranks, t.suffix, t.need = {m: i for i, m in enumerate(merges)}, "", transducer.lookaheads(merges)
    return t


def test_stable_tokens_never_change():
    """For small random merge lists, tokens emitted early are those of the whole word."""
    rng, early = random.Random(2), 0
    for _ in range(150):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(10):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if (u, v) not in merges and len(u + v) < 7 and u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        t = small_transducer(merges)
        for _ in range(20):
            text = [rng.choice("abc") for _ in range(rng.randint(0, 300))]
            w, out = transducer.Word(t), []
            for k, c in enumerate(text):
                w.held.append(c)
                if k % 7 == 0:
                    out += w.stable()
            early += len(out)
            assert out + t.merge(w.held) == t.merge(text)
            assert len(w.held) <= max(t.need.values(), default=0) + 14
    assert early > 100_000


def test_long_runs_without_white_space(library):
    """Pieces, open pre-tokens, endings and marks across steps; equal to the library on all of them."""
    t, lib, rng = transducer.transducer(vocabulary("word_bpe_49k.json")), library["word_bpe_49k"], random.Random(3)
    kinds = ["abcdefgh" * 3, "'sr", "'", "lve", "éÀİ", "e\u0301\u0323", "1２Ⅷ", "!?-", "漢字", "\u1100\u1161\u11a8", "ß", "\u0301", "<|endoftext|>", "the", "ation"]
    for n in (10, 3000, 30_000):
        text = "".join(rng.choice(kinds) for _ in range(n))
        for x in (text, text[: n // 2] + " " + text, "'" * n, "a" * n + "'", text.replace("'", "\t")):
            assert np.frombuffer(t.encode(x), "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids


def test_plain_texts_equal_the_library(library):
    """The whole range of code points that is cut here, in random texts."""
    from synchra.llm.tokens import encoder

    rng = random.Random(4)
    span = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA0, 0x130)), *map(chr, range(0x131, 0x250)), " ", "\n", "\t", "'", "s", "t", "a"]
    enc = {n: encoder(vocabulary(f"{n}.json")) for n in library}
    word = transducer.transducer(vocabulary("word_bpe_49k.json"))
    for k in range(3000):
        text = "".join(rng.choices(span, k=rng.randint(1, 40)) if k % 2 else rng.choices(" \n'stare12.,é", k=rng.randint(1, 60)))
        for n, lib in library.items():
            assert np.frombuffer(enc[n].encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text
        assert word.encode(text) == enc["word_bpe_49k"].encode(text)


def test_transducer_memory_is_flat(library):
    import tracemalloc

    t = transducer.transducer(vocabulary("word_bpe_49k.json"))
    peaks = {}
    for spaced in (True, False):
        for n in (1, 8):
            text = ("word " if spaced else "word-") * (n * 20_000)
            tracemalloc.start()
            d = transducer.Decoder(t)
            for ids in t.encode_pieces(text):
                d.push(np.frombuffer(ids, "<u4").tolist())
            peaks[spaced, n] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
    assert peaks[True, 8] < 1.2 * peaks[True, 1] + 100_000 and peaks[False, 8] < 1.2 * peaks[False, 1] + 100_000, peaks


def test_language_model(spark, docs, texts, empty):
    got = rows(lmscore.scores(docs))
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, ws in toks.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert lmscore.scores(empty).count() == 0
    edge_cases(spark, lmscore.scores)


def test_language_model_learns_word_features(spark):
    """Held-out texts made of sentences from training texts cost less than under the base model; a text learned twice costs less than one learned once, its own occurrence left out."""
    rng = random.Random(11)
    words = [f"w{k}" + rng.choice("abcdefgh") for k in range(400)]
    sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(60)]
    data = [(i, " ".join(rng.sample(sentences, 4))) for i in range(400)]
    once = [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    twice = [(2000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    twice += [(k + 1000, t) for k, t in twice]
    got = rows(lmscore.scores(spark.createDataFrame(data + once + twice, "doc_id long, text string")))
    held = [r for i, r in got.items() if i < 1000 and r.held_out]
    assert sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)
    assert all(r.left_out_score == pytest.approx(r.score) for r in got.values() if r.held_out)
    learned = {i for i in got if not lmscore.held_out(i)}
    single = [got[i].left_out_score / got[i].n_tokens for i in learned if 1000 <= i < 2000]
    double = [got[i].left_out_score / got[i].n_tokens for i in learned if 2000 <= i < 3000 and i + 1000 in learned]
    assert min(double) > max(single)


def test_language_model_evidence_against_counts(spark, tmp_path):
    """Counts of words and features, through files and buckets, against plain counting; gates share 1."""
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    chunks = lmscore.stored(lmscore._cut(spark.createDataFrame(data, "doc_id long, text string").coalesce(2), f"file://{tmp_path}/x"))
    counted = lmscore.stored(lmscore._count(lmscore._chunk_words(chunks, 3), 3))
    vocab = lmscore._vocabulary(counted)
    told = lmscore._count_features(lmscore._features(chunks, 3), 3)
    both = counted.where("chunk is not null").select("chunk", "bucket", "counts").unionByName(told, allowMissingColumns=True)
    answers = lmscore._gathered(both.repartition(2, "chunk").sortWithinPartitions("chunk")).collect()
    words = {i: [None, None, *lmscore.tokens(t.encode())] for i, t in data}
    joint = collections.Counter()
    for i, ws in words.items():
        for k in range(2, len(ws)) if not lmscore.held_out(i) else ():
            joint[ws[k - 1], ws[k]] += 1
            joint[ws[k - 2], ws[k - 1], ws[k]] += 1
    weights = np.zeros((lmscore.ROWS, lmscore.CLASSES), np.float32)
    for r in answers:
        chunk = lmscore._Tokens(r["chunk"])
        known = lmscore.evidence(chunk, r.asDict(), vocab, weights, 3)
        at = 0
        for i in chunk.ids:
            ws = words[i]
            for k in range(2, len(ws)):
                assert known.joint[0, at] == joint[ws[k - 1], ws[k]]
                assert known.joint[1, at] == joint[ws[k - 2], ws[k - 1], ws[k]]
                assert known.before[0, at] == sum(n for f, n in joint.items() if len(f) == 2 and f[0] == ws[k - 1])
                assert known.before[1, at] == (0 if k == 2 else sum(n for f, n in joint.items() if len(f) == 3 and f[:2] == (ws[k - 2], ws[k - 1])))
                at += 1
    theta = np.random.default_rng(1).normal(size=(lmscore.KINDS, lmscore.BINS + 1))
    bins = np.random.default_rng(2).integers(0, lmscore.BINS + 1, (lmscore.KINDS, 200))
    share = lmscore.gates(theta, bins)
    assert np.allclose(share.sum(0), 1) and (share[1:][bins == 0] == 0).all()


def test_language_model_scores_against_plain_counting(spark, monkeypatch):
    """Scores and left-out scores, word by word from plain counts, the trained weights and the gate."""
    kept = {}
    for name in ("_vocabulary", "train", "train_gate"):
        make = getattr(lmscore, name)
        monkeypatch.setattr(lmscore, name, lambda *a, make=make, name=name: kept.setdefault(name, make(*a)))
    rng = random.Random(8)
    data = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "d", "\u00e9t\u00e9", f"x{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 25)))) for i in range(90)]
    got = rows(lmscore.scores(spark.createDataFrame(data, "doc_id long, text string")))
    vocab, weights, theta = kept["_vocabulary"], kept["train"].astype(np.float32), kept["train_gate"][0]
    words = {i: lmscore.tokens(t.encode()) for i, t in data}
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ws in words.items():
        if not lmscore.held_out(i):
            one.update(ws)
            two.update(zip([None, *ws], ws, strict=False))
            three.update(zip([None, None, *ws], [None, *ws], ws, strict=False))
    documents = one[lmscore.END]

    def kind(w):
        return vocab.head.get(w, lmscore.HEAD + lmscore.tail_class(w))

    def cost(ws, own):
        total = 0.0
        for k, w in enumerate(ws):
            a, b = ws[k - 1] if k else None, ws[k - 2] if k > 1 else None
            h = [np.array([kind(ws[k - back]) if k >= back else lmscore.CLASSES]) for back in (1, 2, 3)]
            z = sum(weights[r[0]].astype(float) for r in lmscore.feature_rows(*h))
            c = kind(w)
            p = math.exp(z[c] - z.max()) / np.exp(z - z.max()).sum() * (one[w] - own + 1) / (vocab.class_tokens[c] + vocab.class_types[c] - own + 1)
            context = [(documents if a is None else one[a]) - own, two[b, a] - own if k else 0]
            joint = [two[a, w] - own, three[b, a, w] - own]
            share, mixed = 1.0, p
            for e in range(2):
                if context[e] > 0:
                    g = math.exp(theta[e, min(int(context[e]).bit_length(), lmscore.BINS)])
                    share, mixed = share + g, mixed + g * min(max(joint[e], 0) / context[e], 1)
            total += math.log10(mixed / share)
        return total

    for i, ws in words.items():
        assert got[i].score == pytest.approx(cost(ws, 0), rel=1e-4)
        assert got[i].left_out_score == pytest.approx(cost(ws, int(not lmscore.held_out(i))), rel=1e-4)


def test_language_model_gate_rounds_raise_the_likelihood(spark):
    codes, counts = [], []
    rng = np.random.default_rng(3)
    for _ in range(300):
        code = 0
        for _ in range(lmscore.KINDS):
            code = (code * (lmscore.BINS + 1) + int(rng.integers(0, lmscore.BINS + 1))) * 64 + int(rng.integers(0, 40))
        codes.append(code)
        counts.append(int(rng.integers(1, 9)))
    cases = spark.createDataFrame([(bytearray(lmscore._planes(np.array(codes))), bytearray(lmscore._planes(np.array(counts))))], "codes binary, counts binary")
    _, gains = lmscore.train_gate(cases, 5)
    assert all(b > a for a, b in zip(gains, gains[1:], strict=False))


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(lmscore.ROWS, lmscore.CLASSES))
    h = rng.integers(0, lmscore.CLASSES + 1, (3, 50))
    p = np.exp(lmscore.log_probabilities(w, lmscore.feature_rows(*h)))
    assert np.allclose(p.sum(1), 1)


def test_language(spark, empty):
    rng = random.Random(3)
    parts = {"en": ["the", "thing", "is", "with", "other"], "de": ["der", "schön", "nicht", "und", "über"], "es": ["niño", "que", "los", "ción", "ella"]}
    data = [(i, " ".join(rng.choice(parts[g]) for _ in range(rng.randint(3, 40))), g) for i, g in enumerate(rng.choices(list(parts), k=150))]
    data += [(1000, None, "en"), (1001, "12 !!", "en"), (1002, "", None), (1003, "the other thing", None), (1004, "漢字" * 200, None), (1005, "½ ² ③ Ⅷ ٣", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = rows(langid.report(d))
    assert np.mean([got[i].lang_pred == g for i, _, g in data[:150] if got[i].held_out]) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1005)] == ["und", "und", "und", "en", "und"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.report(empty).count() == 0
    edge_cases(spark, lambda x: langid.report(x.withColumn("lang", F.lit("en"))))
    clash = d.selectExpr("doc_id", "text", "'x' as lang_pred", "2 as score")
    assert {r.doc_id: r.lang_pred for r in langid.predict(clash, langid.learn(d)).collect() if r.doc_id >= 1000} | {1004: None} == {1000: "und", 1001: "und", 1002: "und", 1003: "en", 1004: None, 1005: "und"}
    many = langid.Profiler()
    text = "".join(chr(0x4E00 + k) for k in range(300))
    direct = sum(many.table[many._row(ord(a) << 42 | ord(b) << 21 | ord(c))] for a, b, c in zip(f" {text}", text, f"{text[1:]} ", strict=False))
    assert np.allclose(many.profile(text), direct)


def test_quality(spark, empty):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(200):
        t, bad = words(rng, rng.randint(20, 80)), i % 4 == 0
        data.append((i, " ".join(f"{w}$$$".upper() for w in t.split()) if bad else t))
        labels.append((i, int(not bad)))
    data += [(900, None), (901, "")]
    labels += [(0, 0), (5000, 1), (7, None)]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = rows(quality.report(d, lab))
    assert all((got[i].predicted == 1) == (i % 4 != 0) for i in range(200) if got[i].held_out)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and got[900].score == got[901].score
    assert {r.score for r in quality.report(d, lab.where("false")).collect()} == {0.5}
    assert quality.report(empty, lab).count() == 0
    edge_cases(spark, lambda x: quality.report(x, lab))


def test_discriminant_is_bayes_on_gaussians():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (4000, 2)), rng.normal(1.5, 2, (4000, 2))]
    m = quality.Discriminant.fit(np.array([4000.0, 4000]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0, 0)
    z = np.array([[0.0, 0.0], [3.0, 3.0], [1.0, -1.0]])
    log = lambda mu, s: -((z - mu) ** 2).sum(1) / (2 * s * s) - 2 * np.log(s)
    assert np.allclose(m.scores(z), 1 / (1 + np.exp(log(0, 1) - log(1.5, 2))), atol=0.05)


def brute_links(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    near = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) > 0):
                near[a].add(b)
                near[b].add(a)
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            root[a] = min([root[a], *(root[b] for b in near[a])])
    return near, root


def test_near_duplicates(spark, docs, texts, empty):
    near, root = brute_links(texts)
    got = rows(jaccard.near_duplicates(docs))
    assert {i: r.n_links for i, r in got.items()} == {i: len(near[i]) for i in texts}
    assert {i: r.class_id for i, r in got.items()} == root
    assert jaccard.near_duplicates(empty).count() == 0
    edge_cases(spark, jaccard.near_duplicates)


@pytest.mark.parametrize("block", [1, 8])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    """A node with more members than a block is dealt over units; no link is lost or counted twice."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    data = {}
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        data[i] = " ".join(w)
    for i in range(40, 60):
        data[i] = " ".join(f"y{rng.randrange(10_000)}" for _ in range(50))
    near, root = brute_links(data)
    got = rows(jaccard.near_duplicates(spark.createDataFrame(list(data.items()), "doc_id long, text string")))
    assert {i: r.n_links for i, r in got.items()} == {i: len(near[i]) for i in data}
    assert {i: r.class_id for i, r in got.items()} == root


def test_prefixes_are_shortened_to_the_target_recall():
    floor = jaccard.depth()
    assert jaccard.chance(0.8, floor) >= jaccard.RECALL > jaccard.chance(0.8, floor + 1)
    none = np.zeros(jaccard.BINS)
    alike, least = none.copy(), none.copy()
    alike[-1], least[0] = 1e9, 1e3
    assert jaccard.shorten(alike, jaccard.LONGEST) > jaccard.shorten(least, jaccard.LONGEST) == jaccard.shorten(none, jaccard.LONGEST) == floor
    for found in (alike, least, alike + 1e6):
        d = jaccard.shorten(found, jaccard.LONGEST)
        at = 0.8 + 0.2 * np.arange(jaccard.BINS) / jaccard.BINS
        exist = found / jaccard.chance(at, jaccard.LONGEST)
        assert d == floor or (exist * jaccard.chance(at, d)).sum() >= jaccard.RECALL * exist.sum() - 1


def test_forest_finds_all_links_of_real_documents(spark):
    """Measured recall against brute force on the smallest tables: all of 0.8 and above."""
    raw = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    near, root = brute_links(raw)
    got = rows(jaccard.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert {i: r.n_links for i, r in got.items()} == {i: len(near[i]) for i in raw}
    assert {i: r.class_id for i, r in got.items()} == root


def test_packing(spark, docs, texts, empty, library):
    path, lib = vocabulary("word_bpe_49k.json"), library["word_bpe_49k"]
    got = packing.pack(docs, path).collect()
    by = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in parts] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(pack32(ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0
    edge_cases(spark, lambda d: packing.pack(d, path))


def test_packing_plans_are_valid_and_tight():
    rng = random.Random(7)
    for case in range(60):
        cap = rng.choice([10, 64, 2048])
        lengths = [rng.randint(1, cap) if case % 3 else max(1, int(cap * rng.random() ** 3)) for _ in range(rng.randint(0, 400))]
        h = collections.Counter(lengths)
        p = packing.plan(h, cap)
        n = np.array(sorted(h.elements()), np.int64)
        rank = np.concatenate([np.arange(h[k]) for k in sorted(h)]) if h else np.zeros(0, np.int64)
        b, o = p.place(n, rank)
        fill = collections.defaultdict(list)
        for x, y, z in zip(b, o, n, strict=True):
            fill[x].append((y, z))
        assert sorted(fill) == list(range(p.bins))
        for f in fill.values():
            at = 0
            for y, z in sorted(f):
                assert y == at
                at += z
            assert at <= cap
        bound = max(-(-sum(lengths) // cap), sum(2 * k > cap for k in lengths))
        assert p.bins <= max(bound * 1.23 + 1, bound)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_suffix_arrays():
    rng = random.Random(8)
    for k in range(400):
        x = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))] * (1 + k % 3)
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_substring_dedup(spark, docs, texts, empty, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 6000)
    monkeypatch.setattr(substring_dedup, "STEP", 700)
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    got = rows(substring_dedup.remove_repeats(docs, keep_text=True))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), int(gone.sum()), spans, kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substring_dedup.remove_repeats(empty).count() == 0
    least = spark.createDataFrame([(None, "x" * 60), (-(1 << 63), "x" * 60), (0, "x" * 60)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(least).collect()), key=str) == [(-(1 << 63), 0), (0, 60), (None, 0)]
    edge_cases(spark, substring_dedup.remove_repeats)


def slow_checksum(data):
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def test_ogg(spark, docs, texts, empty):
    got = rows(ogg.media_report(ogg.with_media(docs)))
    for i, t in texts.items():
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.feature.startswith(f"seconds={len(p) / ogg.RATE:.6f};")
    assert ogg.media_report(ogg.with_media(empty)).count() == 0
    edge_cases(spark, lambda d: ogg.media_report(ogg.with_media(d)))


@pytest.mark.parametrize("n", [64, 4096, 255 * 64, 64 * 2000, 64 * 40_000])
def test_ogg_streams(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    media = ogg.write_ogg(payload, n - 3)
    streams = ogg.read_ogg(media)
    assert ogg.payload_of(streams) == (payload, n - 3, n / ogg.RATE)
    assert ogg.checksum(media[:100]) == slow_checksum(media[:100])
    for at in (0, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            ogg.read_ogg(bytes(bad))
    with pytest.raises(ValueError):
        ogg.read_ogg(media[:-1])


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Classes and links follow texts where ids are null or repeated."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    data = [(5, text(0)), (5, text(1)), (5, text(2)), (None, text(3)), (None, text(4)), (8, text(1) + " end"), (9, text(2) + " end"), (10, text(4) + " end"), (11, text(6))]
    got = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == {(5, 5, 1): 2, (5, 5, 0): 1, (None, None, 1): 1, (None, None, 0): 1, (8, 5, 1): 1, (9, 5, 1): 1, (10, None, 1): 1, (11, 11, 0): 1}


def test_near_duplicates_at_a_lower_threshold(spark):
    data = {}
    for k in range(12):
        w = [f"w{k}x{j}" for j in range(104)]
        data[2 * k] = " ".join(w)
        data[2 * k + 1] = " ".join([*w[:73], *(f"z{k}x{j}" for j in range(31))])  # 69 of 131 shingles: 0.53
    near, root = brute_links(data, 0.5)
    got = rows(jaccard.near_duplicates(spark.createDataFrame(list(data.items()), "doc_id long, text string"), 0.5))
    assert {i: r.n_links for i, r in got.items()} == {i: len(near[i]) for i in data} == dict.fromkeys(data, 1)
    assert {i: r.class_id for i, r in got.items()} == root


def test_workers_give_memory_back(spark):
    """Over many partitions, what a reused worker holds between them doesn't grow."""
    import pyarrow as pa

    from synchra.llm.common import BoundedDict, batch, kernel

    schema = pa.schema([("part", pa.int64()), ("mb", pa.float64()), ("cached", pa.int64())])

    def run(batches):
        from synchra.llm.shingles import Shingler

        s, part = Shingler(), 0
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) / 256
        for b in batches:
            for part in b.column("id").to_pylist():
                s.distinct(" ".join(f"{part}w{k}" for k in range(30_000)))
        yield batch(schema, [part], [held], [sum(len(c) * c.cost for c in BoundedDict.every)])

    got = sorted(kernel(spark.range(0, 80, 1, 20), run, "part long, mb double, cached long").collect())
    assert max(r.cached for r in got) <= 160 << 20
    assert max(r.mb for r in got[-4:]) < min(r.mb for r in got[4:8]) + 150
