import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumetext.llm import decontaminate, fingerprints, html_text, language_id, near_dedup, packing, quality, substrings, token_counts, token_files, words

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(rng, n, vocabulary=800):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def ids_of(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ODD = [None, "", " ", "\n\n", "a  b", "a \n b", "x" * 5000, "ü é 日本 ́", "<|endoftext|> a<s>", "a▁b  c ", "same text", "same text", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, very long texts, repeated rows, a null id, and columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(10, "same text", "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, row int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# Token counts


def test_counts_are_the_librarys(spark, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, count in (("piece_bpe_32k.model", lambda t: len(library.encode(t))), ("byte_bpe_50k.json", lambda t: len(ids_of("byte_bpe_50k.json", [t])[0]))):
        got = token_counts.count_tokens(odd, public_tokenizers.path(name), limit=100, batch_bytes=1000)
        expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in odd.collect())
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.collect())
        assert token_counts.count_tokens(empty, public_tokenizers.path(name)).count() == 0


@pytest.mark.parametrize("span", [64, 1 << 20])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_match_on_random_texts(name, span, monkeypatch):
    """Against the library, over spans that cut texts anywhere it is safe, with a table that is emptied again and again."""
    from lumetext.llm import pieces

    monkeypatch.setattr(pieces, "_SPAN", span)
    monkeypatch.setattr(pieces, "_KNOWN_BYTES", 5000)
    rng = random.Random(span)
    letters = [*"ab0'éü ,.\n\t  ́▁<|3三\r×÷İßſĿ\x1f\x00\x85 -", "<s>", "<|endoftext|>", " 's", "  ", "longword", " a", "'re", " 12", "thing.", "x" * 20]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(rng.choices(texts, k=40)) for _ in range(20)]
    encoder = pieces.TokenizerPieces(public_tokenizers.path(name), limit=500)
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        ids, before = encoder.encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, before[1:-1])] == ids_of(name, some)
        ids, before = encoder.encode(pa.array(some), 7)
        assert [x.tolist() for x in np.split(ids, before[1:-1])] == [[*x, 7] for x in ids_of(name, some)]
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_units_of_equal_hash_are_told_apart(monkeypatch):
    from lumetext.llm import pieces

    monkeypatch.setattr(pieces, "mix", lambda x: x & np.uint64(3))
    encoder = pieces.TokenizerPieces(public_tokenizers.path("byte_bpe_50k.json"), limit=200)
    texts = [f"a{i} b{i}, c" for i in range(60)]
    ids, before = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, before[1:-1])] == ids_of("byte_bpe_50k.json", texts)


# Token files


def test_token_files_round_trip(spark, odd, empty):
    name = "word_bpe_49k.json"
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.where("doc_id is not null").collect()))
    got = sorted(tuple(r) for r in token_files.round_trip(odd.where("doc_id is not null"), public_tokenizers.path(name)).collect())
    assert [(d, n, c) for d, _, n, c in got] == [(d, len(i) + 1, crc([*i, 2])) for (d, _), i in zip(rows, ids_of(name, [t for _, t in rows]), strict=True)]
    assert sorted(s for _, s, _, _ in got) == np.concatenate([[0], np.cumsum([n for _, _, n, _ in sorted(got, key=lambda r: r[1])])[:-1]]).tolist()
    assert [d for d, *_ in sorted(got, key=lambda r: r[1])] == sorted(d for d, _ in rows)
    assert token_files.round_trip(odd, public_tokenizers.path(name)).count() == len(ODD) + 2
    assert token_files.round_trip(empty, public_tokenizers.path(name)).count() == 0


def test_shard_reads_one_document():
    data = [np.arange(n, dtype="<u2") for n in (3, 0, 500)]
    dictionary = token_files.train_dictionary([np.random.default_rng(i).integers(0, 50, 400).astype("<u2").tobytes() for i in range(200)], 4096)
    write = token_files.zstandard.ZstdCompressor(**token_files._shared(dictionary))
    raw = token_files.shard_bytes_of([7, 8, 9], [3, 0, 500], [write.compress(x.tobytes()) for x in data], dictionary, 2)
    shard = token_files.Shard(raw, dictionary)
    assert dictionary and shard.ids(2).tolist() == data[2].tolist() and shard.ids(1).tolist() == []
    assert [x.tolist() for x in shard.all_ids(step=1)] == [x.tolist() for x in data]
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Shard(raw, b"other")


def test_a_short_document_is_read_by_two_short_reads(spark, tmp_path):
    """The index and one frame, however large the file; and a range is cut into files by bytes."""
    rng = random.Random(17)
    docs = frame(spark, [(i, prose(rng, 400, 10**6)) for i in range(50)]).coalesce(1)
    name = "word_bpe_49k.json"
    manifest = token_files.write_token_files(docs, str(tmp_path), public_tokenizers.path(name), shard_bytes=10_000).orderBy("start").collect()
    assert len(manifest) > 4 and sum(r["n_docs"] for r in manifest) == 50 and len({r["shard"] for r in manifest}) <= 4
    dictionary = (tmp_path / "dictionary").read_bytes()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    row = max(manifest, key=lambda r: r["n_docs"])
    raw = (tmp_path / row["file"]).read_bytes()

    class Counted(token_files.io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    shard = token_files.Shard(Counted(raw), dictionary)
    last = shard.n - 1
    assert shard.ids(last).tolist() == [*ids_of(name, [texts[int(shard.doc_ids[last])]])[0], 2]
    assert shard._source.taken < len(raw) / 2
    got = sorted(token_files.round_trip(docs, public_tokenizers.path(name), shard_bytes=10_000).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == list(range(50)) and got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])


def test_addresses_of_stores():
    system, path = token_files.file_system("file:///tmp/x")
    assert path == "/tmp/x" and token_files.file_system("/tmp/x")[1] == "/tmp/x"


@pytest.mark.parametrize("width", [2, 4])
def test_dictionary_sample_is_from_the_whole_document(width):
    ids = np.arange(20_000, dtype=f"<u{width}")
    got = np.frombuffer(token_files.sampled(ids.tobytes(), 4096, width), f"<u{width}")
    assert got.nbytes <= 4096 and got[0] == 0 and got[-1] == 19_999
    assert np.bincount(got.astype(int) * 8 // 20_000, minlength=8).min() > 0
    assert token_files.sampled(ids[:100].tobytes(), 4096, width) == ids[:100].tobytes()


def test_late_parts_of_documents_reach_the_dictionary(spark, tmp_path):
    """Documents that have nothing in common but a passage at their end, far beyond the bytes that are sampled."""
    rng = random.Random(41)
    late = prose(rng, 3000, 10**6)
    docs = frame(spark, [(i, prose(rng, 6000, 10**6) + " " + late) for i in range(24)])
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(docs, str(tmp_path), path, dictionary_size=16_384)
    passage = np.array(ids_of("word_bpe_49k.json", [late])[0], dtype="<u2")
    held = (tmp_path / "dictionary").read_bytes()
    hits = sum(passage[k : k + 24].tobytes() in held for k in range(len(passage) - 24))
    assert hits > 100


# Packing


def check_packing(rows, texts, capacity=2048):
    by_sequence: dict = {}
    pieces: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for (doc_id, _), ids in zip(texts, ids_of("byte_bpe_50k.json", [t or "" for _, t in texts]), strict=True):
        ids, at = [*ids, 0], 0
        for k, (piece, start, length, check) in enumerate(sorted(pieces[doc_id])):
            assert (piece, start) == (k, at) and check == crc(ids[at : at + length])
            assert length == capacity or k == 0
            at += length
        assert at == len(ids)
    return len(by_sequence)


def first_fit(lengths, capacity=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(capacity - n)
        else:
            rooms[k] -= n
    return len(rooms)


def test_packing(spark, empty):
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.choice([3, 50, 300, 900, 2500]))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows = packing.pack(frame(spark, texts).repartition(5), public_tokenizers.path("byte_bpe_50k.json")).collect()
    used = check_packing(rows, texts)
    assert used <= first_fit([r["length"] for r in rows]) + 1
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    again = packing.pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(again) == 3 and len({(r["sequence_id"], r["offset"]) for r in again}) == 3


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 101, 400) if seed % 2 else np.minimum(rng.lognormal(3, 1, 400).astype(int) + 1, 100), minlength=101)
    bins = packing.plan(counts)
    got = Counter()
    for times, items in bins:
        assert sum(items) <= 100 and times > 0
        for n in items:
            got[n] += times
    assert got == Counter({n: int(c) for n, c in enumerate(counts) if c})
    # the greedy fill leaves 90; its smallest, 30, goes for 20 and 20
    assert (1, (60, 20, 20)) in packing.plan(np.bincount([60, 30, 20, 20], minlength=101))


# Substring dedup


def brute_repeats(rows, window):
    split = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substrings(spark, empty, odd):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (34, 35, 36, 80)]
    rows = [(i, " ".join(rng.sample(shared, rng.randint(0, 2)) + [prose(rng, rng.randint(0, 60))])) for i in range(60)]
    rows += [(100, "a b " * 40), (101, prose(random.Random(9), 50)), (102, prose(random.Random(9), 50)), (103, ""), (104, None), (105, "x y z " * 30), (105, shared[3]), (106, shared[3]), (106, shared[3])]
    for parts in (1, 6):
        got = substrings.remove_repeats(frame(spark, rows).repartition(parts), 35).select("row.doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 35)
    assert substrings.remove_repeats(empty).count() == 0
    out = substrings.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id in (12, 6)").collect()} == {"", "x" * 5000}


def test_chunks_of_a_task(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60, 3)) for i in range(40)]
    docs = frame(spark, rows).coalesce(1).withColumns({"row_key": F.xxhash64("doc_id", "text"), "id_key": F.col("doc_id")})
    one = sorted(map(tuple, substrings.repeated_spans(docs, 5).collect()))
    assert one == sorted(map(tuple, substrings.repeated_spans(docs, 5, chunk_bytes=500).collect()))


def test_windows_of_equal_hash_are_told_apart():
    """Equal first hashes with different second ones stand apart, however they are mixed."""
    found, check = np.array([7, 5, 7, 7, 5], dtype=np.uint64), np.array([1, 3, 2, 1, 3], dtype=np.uint64)
    order, same = substrings.ordered(found, check)
    pairs = list(zip(found[order].tolist(), check[order].tolist(), strict=True))
    assert [a == b for a, b in zip(pairs, pairs[1:], strict=False)] == same.tolist() and same.sum() == 2


def test_ranges_follow_the_input():
    small, large = substrings.layout(10**9, 50), substrings.layout(170 * 10**12, 50)
    assert small == (9, 4_000_000) and 170 * 10**12 >> large[0] <= 130_000_000 and large[1] == 64_000_000


def test_word_hashes():
    texts = ["a bc\tb", "", " a\nabc ", "b" * 300_000 + " a", "x\x0by"]
    data, offsets = words.text_buffer(pa.array(texts))
    starts, ends, counts = words.spans(data, offsets)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in t.encode().split()]
    h = words.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len({w for t in texts for w in t.encode().split()}) and h[0] == h[3]
    assert np.diff(counts).tolist() == [len(t.encode().split()) for t in texts]


# Near-duplicates


def test_alignment():
    rng = random.Random(2)
    for _ in range(800):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 11))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in range(12):
            assert near_dedup.few_edits(a, b, most) == near_dedup.banded(a, b, most) == (row[-1] if row[-1] <= most else None)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in text.split())


def test_near_classes(spark, empty, odd):
    rng = random.Random(6)
    base = [prose(rng, rng.choice([40, 120, 400]), 5000) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(rng, base[i], 0.03)) for i in range(30)] + [(200 + i, base[i].upper() + "!") for i in range(10)]
    rows += [(300 + i, edited(rng, base[0], 0.02)) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows).repartition(4)).collect()}
    expected = {i: i for i in range(40)} | {100 + i: i for i in range(30)} | {200 + i: i for i in range(10)} | {300 + i: 0 for i in range(30)}
    assert got == expected
    kept = near_dedup.keep_one(frame(spark, rows).withColumn("spans", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40)) and kept.columns == ["doc_id", "text", "spans"]
    assert near_dedup.classes(empty).count() == near_dedup.keep_one(empty).count() == 0
    classes = near_dedup.classes(odd).collect()
    assert len(classes) == odd.count()
    by_text = {(r["doc_id"], r["class_id"]) for r in classes}
    assert {(0, 0), (1, 0), (10, 10), (11, 10), (None, None)} <= by_text
    one = near_dedup.keep_one(odd).collect()
    assert sum(r["text"] == "same text" for r in one) == 1 and sum(not r["text"] for r in one) == 1 and sum(r["doc_id"] is None for r in one) == 1


def edits(a, b):
    row = np.arange(len(b) + 1)
    at = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - at) + at
    return int(row[-1])


def brute_classes(texts, similarity):
    """The classes by aligning every two texts that have a word in common."""
    w = [np.array([zlib.crc32(x.encode()) for x in t.lower().split()]) for t in texts]
    parent = list(range(len(w)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(w)):
        for j in range(i):
            long = max(len(w[i]), len(w[j]))
            if root(i) != root(j) and sum((Counter(w[i].tolist()) & Counter(w[j].tolist())).values()) >= similarity * long - 1e-9 and edits(w[i], w[j]) <= (1 - similarity) * long + 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(w))]


def test_near_classes_of_a_template(spark):
    """Pairs of near copies among many texts that share most of their words with all others."""
    rng = random.Random(21)
    template = prose(rng, 140, 5000)
    texts = []
    for i in range(60):
        one = template + " " + " ".join(f"own{rng.randrange(10**7)}" for _ in range(60))
        texts += [one, edited(rng, one, 0.05)]
    expected = brute_classes(texts, 0.8)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, enumerate(texts)).repartition(4)).collect()}
    assert len(set(expected)) == 60
    assert [got[i] for i in range(len(texts))] == expected
    docs = frame(spark, enumerate(texts))
    reps = near_dedup.representatives(near_dedup.sketches(docs, 5, 24))
    some = near_dedup.connected(docs, reps, 0.8, block=16)
    number = {r["rep"]: r["doc_id"] for r in reps.collect()}
    got = {number[r["id"]]: r["label"] for r in some.collect()}
    groups: dict = {}
    for i, label in enumerate(expected):
        groups.setdefault(label, set()).add(got.get(i, ("alone", i)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == 60


def test_texts_of_one_id_stay_apart(spark):
    """Unlike texts under one doc_id, a near copy of one of them, and a column that is named as a key could be."""
    rng = random.Random(51)
    one, two, three = prose(rng, 80, 5000), prose(rng, 80, 5000), prose(rng, 80, 5000)
    near = " ".join(["changed", *one.split()[1:]])
    docs = frame(spark, [(3, one), (7, near), (7, two), (9, three), (None, two + " x")]).withColumns({"kept_row_key": F.lit(1), "row_key": F.lit(2), "rep": F.lit(3)})
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in near_dedup.classes(docs).collect()) == [(0, 7), (3, 3), (7, 3), (7, 7), (9, 9)]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(3, one), (7, two), (9, three)}


def test_what_signatures_rule_out_is_unlike():
    """No pair within the threshold is ruled out, whatever the leader; and the distances hold."""
    rng = random.Random(52)

    def change(w, share):
        w = list(w)
        for _ in range(rng.randrange(int(share * len(w)) + 2)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [rng.randrange(12)] * rng.randrange(2)
        return w or [1]

    for _ in range(200):
        leader = [rng.randrange(12) for _ in range(rng.choice([1, 2, 3, 10, 40, 130]))]
        texts = [change(leader, rng.choice([0.1, 0.3, 0.6])) for _ in range(6)]
        hashed = [np.array(w, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for w in texts]
        own = np.array(leader, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bounds = []
        for w in hashed:
            low, high = near_dedup.distance(own, w, 0.8, True)
            true = edits(own, w)
            assert low <= true <= high and (true > near_dedup.threshold(max(len(own), len(w)), 0.8) or low == high)
            bounds.append((low, high))
        counts = np.concatenate([[0], np.cumsum([len(w) for w in hashed])])
        bins, bits = near_dedup.signature(np.concatenate(hashed), counts)
        n = len(texts)
        columns = {"rep": list(range(n)), "part": [0] * n, "home": [True] * n, "component": list(range(n)), "words": np.diff(counts), "leader": [[5]] * n, "low": [[x] for x, _ in bounds], "high": [[x] for _, x in bounds], "bins": bins, "bits": bits, "buckets": [[7, i] for i in range(n)]}
        got = {tuple(sorted(p)) for p in near_dedup.Members(pa.RecordBatch.from_pydict(columns)).pairs(0.8)}
        for i in range(n):
            for j in range(i):
                if edits(hashed[i], hashed[j]) <= near_dedup.threshold(max(len(texts[i]), len(texts[j])), 0.8):
                    assert (j, i) in got
                    # what is alike to a text alike to the leader is within reach of the leader
                    assert not (bounds[i][1] == near_dedup.UNKNOWN and bounds[j][1] <= near_dedup.threshold(max(len(own), len(texts[j])), 0.8))


def test_chains_are_one_class(spark):
    """Texts that are alike only to the one before and the one after: each step changes 15 other words of 100."""
    rng = random.Random(53)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randrange(50_000)}" for _ in range(100)]
        places = rng.sample(range(100), 100)
        for step in range(7):
            texts.append(" ".join(w))
            for k in places[15 * step % 100 : 15 * step % 100 + 15]:
                w[k] = f"n{rng.randrange(10**7)}"
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, enumerate(texts)).repartition(4)).collect()}
    linked = sum(got[i] == got[i + 1] for i in range(len(texts) - 1) if i // 7 == (i + 1) // 7)
    assert linked >= 0.98 * 25 * 6 and len(set(got.values())) >= 25


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_near_recall(spark, similarity):
    """Texts that are only just alike, by scattered changes."""
    rng = random.Random(31)
    texts, pairs = [], 0
    for n in [5, 12, 20, 60, 100, 300]:
        changes = int((1 - similarity) * n + 1e-9)
        for _ in range(60 if changes else 0):
            one = prose(rng, n, 50_000).split()
            two = list(one)
            for k in rng.sample(range(n), changes):
                two[k] = f"n{rng.randrange(10**7)}"
            assert edits(np.array(one), np.array(two)) <= (1 - similarity) * n + 1e-9
            texts += [" ".join(one), " ".join(two)]
            pairs += 1
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, enumerate(texts)).repartition(4)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) >= 0.99 * pairs
    assert len(set(got.values())) >= pairs


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["label"] for r in near_dedup.components(frame(spark, edges, "a long, b long")).collect()}
    assert len({(got.get(x, x), root(x)) for x in parent}) == len({got.get(x, x) for x in parent}) == len({root(x) for x in parent})
    assert near_dedup.components(frame(spark, [], "a long, b long")).count() == 0


# Language


def test_language(spark, empty, odd):
    rng = random.Random(7)
    own = {"fr": ["eau", "ier", "tion", "le", "que"], "es": ["ción", "ado", "mente", "ez", "los"], "en": ["the", "ing", "th", "wh", "and"], "de": ["sch", "keit", "ung", "der", "pf"], "xx": ["qq", "zz", "kk", "jj", "vv"]}
    rows = [(i, " ".join("".join(rng.choices(own[lang], k=2)) for _ in range(40)), lang) for i, lang in enumerate(list(own) * 60)]
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.identify(docs, per_language=20).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    assert {language_id.family("fr"), language_id.family("es-MX")} == {"family:romance"}
    model = language_id.fit(docs, 20)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(odd, model).collect()}[0] == "und"
    rejected = set(range(13)) - {r["doc_id"] for r in language_id.predict(odd, model).collect() if r["lang_pred"] != "und"}
    assert rejected == {0, 1, 2, 3}
    none = language_id.identify(frame(spark, [(1, "a", None)], "doc_id long, text string, lang string")).collect()
    assert [r["lang_pred"] for r in none] == ["und"] and language_id.identify(empty).count() == 0
    kept = language_id.keep_identified(docs.unionByName(frame(spark, [(900, "123 !!", "fr"), (901, None, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(len(rows)))


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(0)
    machine = [("family:a", "family:b", rng.normal(size=1 << language_id.BITS), 0.1)]
    model = language_id.Hierarchy(machine, ["a", "b"])
    texts = ["abc def", "", "x" * 40 + " yz", "ab"] + ["wort " * 50] * 3
    whole = model.margins(pa.array(texts))
    expected = [v @ machine[0][2] + 0.1 for v in language_id.shares(pa.array(texts))]
    assert np.allclose(whole[:, 0], expected)
    span, language_id._SPAN = language_id._SPAN, 7
    try:
        assert np.allclose(model.margins(pa.array(texts)), whole)
    finally:
        language_id._SPAN = span


# Quality


def test_quality(spark, odd):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        good = rng.random() < 0.7
        w = prose(rng, 60).split()
        rows.append((i, " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$", "!!"]) for x in w), int(good)))
    docs = frame(spark, [r[:2] for r in rows])
    labels = frame(spark, [(i, q if i % 5 else None) for i, _, q in rows] + [(None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs.repartition(4), labels).collect()}
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) / len(held) > 0.95
    assert all(got[i]["predicted"] == (got[i]["score"] >= 0.7) for i in got)
    odd_scores = quality.classify(odd, labels.limit(0)).collect()
    assert len(odd_scores) == odd.count() and {r["score"] for r in odd_scores} == {0.5}
    assert {r["score"] for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<html><nav><a>Home</a></nav><article><h1>T&#233;st</h1><p>One,  two\n three.<br><p><b>Four</b>!<div class=ad>Buy</div></article><footer>&copy; x", "Tést\nOne, two three.\nFour!"),
        ("<body><div id=main><h2>Head</h2><p>" + "Long text, with commas, and words. " * 5 + "</p><p>Short.</p></div><div class=sidebar><p>" + "Other text, " * 30 + "</p></div><ul><li><a>x</a><li><a>y</a></ul></body>", "Head\n" + ("Long text, with commas, and words. " * 5).strip() + "\nShort."),
        ("<article><p>" + "Text, " * 30 + "<script>if (a < b) { '</p>' }</script><style>p{}</style></p><section class='comments'><p>Nice post, really, I mean it, all of it.</p></section><form><p>Mail</p></form></article>", ("Text, " * 30).strip()),
        ("<!-- <article>no</article> --><main><p>a</b></p><p hidden>b</p><p style='display: none'>c</p></main>", "a"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark):
    pages = frame(spark, [(1, "u", "<article><p>Hé</p></article>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect() if r["url"]) == [(1, "u", "Hé", 2)]
    assert html_text.extract(pages).count() == 3 and html_text.extract(pages.limit(0)).count() == 0
    deep = "<div>" * 3000 + "<p>deep text here, and more of it</p>" + "</div>" * 3000
    assert html_text.main_text(deep) == "deep text here, and more of it"


@pytest.mark.parametrize("part", ["<b>", "<a ", "<header>", "<table><i>", "<p class='x ", '<a "', "</script ", "<!", "<div><span>"])
def test_time_of_odd_pages_is_linear(part):
    """100,000 tags that are never closed, with end tags of nothing after them."""
    page = part * 100_000 + "</i>" * 100_000 + "<p>text</p>"
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_comments_that_never_end():
    assert html_text.main_text("<p>a</p><!-- b <p>c</p> d") == "a"
    assert html_text.main_text("<p>a</p><p>b < c <= d</p> e <f") == "a\nb < c <= d\ne <f"


# Decontamination


def test_leaks(spark, empty):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([18, 30, 45, 90]), 3000) + ". The answer is x" + str(i)) for i in range(30)]
    docs = []
    for i in range(120):
        body = prose(rng, rng.choice([50, 300]), 3000)
        if i < 30:
            body = body + " " + items[i][1] + " " + prose(rng, 40, 3000)
        elif i < 45:
            w = items[i - 30][1].split()
            for _ in range(len(w) // 8):
                w[rng.randrange(len(w) - 6)] = "other"
            body = body + " " + " ".join(w).upper() + " " + body
        docs.append((i, body))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (502, docs[0][1])]
    benchmark = frame(spark, [*items, (900, None), (901, "")], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, docs).repartition(4), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found == {(i, i) for i in range(30)} | {(30 + i, i) for i in range(15)} | {(502, 0)}
    assert sum(r["doc_id"] == 502 for r in got) == 2
    table = frame(spark, docs).withColumn("cosine", F.lit(1))
    clean = decontaminate.drop_contaminated(table, benchmark)
    assert clean.columns == table.columns and sorted(r["doc_id"] for r in clean.collect()) == [*range(45, 120), 500, 501]
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(frame(spark, docs), benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(table, benchmark.limit(0)).count() == len(docs)


def brute_leaks(docs, items, common=0.6, answer=0.5):
    """By the longest common subsequence of every item with every stretch of every text."""
    hashed = lambda t: near_dedup.word_hashes(pa.array([t]))[0].tolist()
    found = set()
    for item_id, item in items:
        words = hashed(item)
        n, start = len(words), decontaminate.answer_start(item, len(words))
        full, masks = (1 << n) - 1, {}
        for i, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << i
        for doc_id, text in docs:
            body = hashed(text)
            for at in range(0, len(body), max(1, n // 4)):
                v = full
                for w in body[at : at + n + n // 2]:
                    u = v & masks.get(w, 0)
                    v = ((v + u) | (v - u)) & full
                got = full & ~v
                if got.bit_count() >= common * n and (got >> start).bit_count() >= answer * (n - start):
                    found.add((doc_id, item_id))
    return found


def test_leaks_beside_stuttered_words(spark):
    """Items in texts that repeat one of their words over and over, and with 30 to 40 % of the words replaced."""
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(["it", "de", f"w{rng.randrange(600)}", f"w{rng.randrange(600)}"]) for _ in range(rng.choice([12, 20, 40, 90]))) + f". The answer is x{i} y{i}") for i in range(24)]
    docs = []
    for i, (_, item) in enumerate(items):
        for k, share in enumerate([0, 0, 0.3, 0.35, 0.4]):
            one = " ".join(w if rng.random() >= share else f"n{rng.randrange(999)}" for w in item.split())
            run = [rng.choice(["it", "de", item.split()[2]])] * rng.choice([40, 150]) if k != 2 else prose(rng, 80, 600).split()
            docs.append((10 * i + k, " ".join([*run, one, *run])))
    docs += [(1000 + i, prose(rng, 200, 600)) for i in range(20)]
    expected = brute_leaks(docs, items)
    got = decontaminate.find_leaks(frame(spark, docs).repartition(4), frame(spark, items, "item_id long, text string")).collect()
    assert len(expected) > 60
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected
    assert all(-1.001 <= r["cosine"] <= 1.001 for r in got)


def test_leak_search_work():
    """The cosines are those of the windows' own words; few of the windows that look like an item are walked word by word; groups of texts change nothing."""
    rng = random.Random(13)
    common = [f"c{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.choice([9, 20, 44, 70]))) + f". The answer is x{i}") for i in range(20)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 3, 8, 17, 63, 64, 200, 500]))) for _ in range(150)]
    texts[5:25] = [f"{texts[i]} {item} {texts[i + 1]}" for i, (_, item) in enumerate(items)]
    column = pa.array(texts)
    known = decontaminate.Items(items)
    omega = np.vstack([decontaminate.random_matrix(len(known.vocabulary)), np.zeros(decontaminate.RANK)])
    passages, frequency, z = decontaminate.gathered(known, column, 64, omega)
    space = decontaminate.Space(known, passages, frequency, z.T)
    hashed, counts = near_dedup.word_hashes(column)
    number = known.numbers(hashed)
    like, n_candidates, n_batches = {}, 0, 0
    for batch in space.candidates(number, counts, 0.1):
        n_candidates, n_batches = n_candidates + len(batch[0]), n_batches + 1
        for text, item, a, b, cosine in zip(*(c.tolist() for c in batch), strict=True):
            like[text, item, a, b] = max(cosine, like.get((text, item, a, b), -1))
    for blocks, step, of, unit, least in space.scales:
        for text in range(len(texts)):
            for a in range(counts[text], counts[text + 1], step * decontaminate.BLOCK):
                b = min(a + blocks * decontaminate.BLOCK, counts[text + 1])
                total = space.rows[number[a:b]].sum(axis=0, dtype=float)
                cosines = unit @ total[:-1] / max(np.linalg.norm(total[:-1]), 1e-12)
                for k in np.flatnonzero((cosines >= 0.101) & (total[-1] >= least * 1.001)):
                    assert like[text, int(of[k]), a, b] >= cosines[k] - 1e-4
    walked = []

    class Counted(decontaminate.Space):
        def present(self, item, *rest):
            walked.append(len(item))
            return super().present(item, *rest)

    space.__class__ = Counted
    found = decontaminate.leaks_of(space, column, 0.1, 0.6, 0.5)
    assert {(5 + i, i) for i in range(20)} <= set(found)
    assert set(found) == {(t, i) for t, i in brute_leaks(list(enumerate(texts)), items)}
    assert n_candidates > 1000 and sum(walked[:n_batches]) < n_candidates / 2
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "_ANCHORS", 40, raising=False)
        again = decontaminate.leaks_of(space, column, 0.1, 0.6, 0.5)
    assert again.keys() == found.keys() and all(again[k] == pytest.approx(found[k], abs=1e-5) for k in found)


# Fingerprints


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark, empty):
    rng = random.Random(12)
    rows = [(7 * i, prose(rng, rng.choice([0, 1, 4, 5, 40, 100]), 2000)) for i in range(300)] + [(5000, None), (5001, "é" * 10)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(frame(spark, rows).repartition(4)).collect()}
    order = sorted(rows, reverse=True)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited_text = text[: n - n // 3] + after[: n // 3]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited_text.encode()).hexdigest())
        for other, near in ((edited_text, r["near_edited"]), (after, r["near_next"])):
            a, b = shingles(text), shingles(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)  # exact below k shingles
    assert fingerprints.fingerprint_edits(empty).count() == 0
    alone = fingerprints.fingerprint_edits(frame(spark, [(3, "a b c")])).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] < 1
    twice = fingerprints.fingerprint_edits(frame(spark, [(3, "a b c"), (3, "a b c"), (None, "z")])).collect()
    assert len(twice) == 3 and len({r["fingerprint"] for r in twice if r["doc_id"] == 3}) == 1


def test_far_ids_do_not_widen_blocks(spark):
    rows = [(i, "a b") for i in range(2000)] + [(10**15, "c"), (-(10**15), "d"), (None, "e")]
    docs = frame(spark, rows)
    got = docs.select("doc_id", fingerprints.blocks(docs, 64).alias("block")).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r["block"] for r in got] == sorted(r["block"] for r in got)
    assert max(Counter(r["block"] for r in got).values()) <= 130
    after = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(after) == len(rows) and after[10**15]["near_next"] == 0.0 and after[5]["near_next"] == 1.0


def test_sketch_estimates(spark):
    rng = random.Random(13)
    a = prose(rng, 3000, 10**6)
    b = a + " " + prose(rng, 3000, 10**6)
    row = frame(spark, [(1, a, b)], "i int, a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = row.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(F.col("b")).alias("n"), (fingerprints.merged(F.col("a"), F.col("b")) == F.col("b")).alias("whole")).first()
    assert abs(r["r"] - 0.5) < 0.1 and r["c"] > 0.85 and abs(r["n"] / 5996 - 1) < 0.2 and r["whole"]
