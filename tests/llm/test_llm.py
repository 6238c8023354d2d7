"""Operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

from docloom.llm import ann, bpe, chat, fingerprint, linededup, packing, quality, setjoin, sharding, tokenfiles, words
from docloom.llm.components import connected_components
from docloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def odd_documents(spark):
    texts = ["", None, "one", "one two", "A b c d e f g h i j k l", "a b c d e f g h i j k l", LONG, LONG, "tie", "tie", "  \n\t\n ", "x\ny\nx", "é ü " * 50, "z" * 9000]
    rows = [(i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None), (3, "one two", "en", "src0", 7, "again")]
    return spark.createDataFrame(rows, SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# Packing


def exact_bins(sizes, capacity):
    """The least number of bins by search over small instances."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(room)
            place(i + 1, rooms[:k] + [room - sizes[i]] + rooms[k + 1 :])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_and_best_fit_are_close_to_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 37])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    counts = {s: sizes.count(s) for s in sizes}
    patterns = packing.solve(counts, capacity)
    used = {}
    for pattern, n in patterns:
        assert sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            used[s] = used.get(s, 0) + k * n
    assert used == counts
    bins = sum(n for _, n in patterns)
    assert exact_bins(sizes, capacity) <= bins <= exact_bins(sizes, capacity) + 1


def test_dominance_fixes_pairs_that_fit_exactly():
    assert sum(n for _, n in packing.solve({7: 1000, 3: 1000, 10: 5}, 10)) == 1005
    assert packing.solve({}, 10) == []


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for found in by.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_packing_of_odd_documents(spark):
    path = P.path("word_bpe_49k.json")
    docs = odd_documents(spark)
    packed = packing.pack_documents(docs, path, capacity=256).collect()
    bins = check_packed(packed, 256)
    assert bins <= sum(r["length"] for r in packed) / 256 + 2
    tokenizer = words.hf_tokenizer(path)
    for row in docs.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        pieces = [r for r in packed if r["doc_id"] == row["doc_id"]]
        assert {(r["piece"], r["start"], r["ids_crc32"]) for r in pieces} >= {(k, k * 256, zlib.crc32(np.array(ids[k * 256 : k * 256 + 256], "<u4").tobytes())) for k in range(-(-len(ids) // 256))}
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9, 1)], "doc_id long, piece int, length long, ids_crc32 long"), 8)


def test_pieces_with_ids(spark):
    rows = packing.token_pieces(odd_documents(spark).where("doc_id = 4"), P.path("word_bpe_49k.json"), 4, with_ids=True).orderBy("piece").collect()
    assert [len(r["ids"]) for r in rows] == [r["length"] for r in rows] and rows[-1]["ids"][-1] == 1


# Encoders


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", words.word_pieces), ("byte_bpe_50k.json", words.byte_pieces)])
def test_pieces_encode_as_whole_texts_do(name, cut):
    rng = random.Random(4)
    signs = ["a", "B", "1", " ", "\n", "\t", "'", "s", "é", " ", "_", "$", "日", "́", "\r", " ", "\x1c", "İ"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)] + [None, "<|endoftext|> it's", "trail  ", LONG]
    tokenizer = words.hf_tokenizer(P.path(name))
    for text, ids in zip(texts, words.TextEncoder.of_tokenizer(P.path(name), cut).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", words.word_pieces), ("byte_bpe_50k.json", words.byte_pieces)])
def test_added_tokens_encode_as_the_library_does(name, cut):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path(name))
    texts = ["Before it", "Hello  <|endoftext|> There", "", "<|startoftext|>x<|endoftext|><|endoftext|>", "<|endof", "text|> A", "<|ENDOFTEXT|> é", "é<|endoftext|>\n\nit's", None, "<|endoftext|>", "After it "]
    for text, ids in zip(texts, words.TextEncoder.of_tokenizer(P.path(name), cut).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert tokenizer.encode(texts[1], add_special_tokens=False).ids.count(tokenizer.token_to_id("<|endoftext|>")) == 1


def test_piece_table_forgets_and_grows(monkeypatch):
    monkeypatch.setattr(words, "PIECES", 50)
    table = words.PieceTable(lambda parts: [np.frombuffer(p, np.uint8).astype(np.uint32) for p in parts])
    encoder = words.TextEncoder.__new__(words.TextEncoder)
    encoder._table, encoder._pieces = table, words.byte_pieces
    texts = [" ".join(f"{k}x{i}" for i in range(40)) for k in range(30)]
    for _ in range(2):
        for text in texts:
            (ids,) = encoder.encode(pa.array([text]))
            assert bytes(ids.tolist()) == text.encode()


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    docs = odd_documents(spark).unionByName(documents(spark), allowMissingColumns=True)
    texts = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    rows = bpe.encode_documents(docs, path, P.PATTERN, with_ids=True).collect()
    got = {(r["doc_id"], bytes(r["decoded"]).decode(), tuple(r["ids"])) for r in rows}
    assert got == {(i, t, tuple(encoding.encode_ordinary(t))) for i, t in texts}
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in rows)


def test_rank_queue_pops_in_order():
    rng = random.Random(2)
    queue, held = bpe.RankQueue(50_000), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert queue.pop() == held.pop(0)
        else:
            entry = (rng.randrange(50_000) if rng.random() < 0.7 else 7, rng.randrange(1000))
            queue.push(*entry)
            held = sorted([*held, entry])
    assert [queue.pop() for _ in held] == held and queue.pop() is None


def test_token_files(spark):
    docs = odd_documents(spark)
    manifest = tokenfiles.write_token_files(docs, P.path("byte_bpe_50k.json"), 2)
    rows = tokenfiles.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    tokenizer, at = words.hf_tokenizer(P.path("byte_bpe_50k.json")), 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in docs.collect()), key=lambda d: (d is not None, d))
    for r in rows:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids"] in [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[r["doc_id"]]]
        at += r["n_tokens"]
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 2**32, 1024), np.zeros(256), rng.zipf(1.2, 2560) % 50_000, np.full(256, 2**32 - 1)):
        ids = ids.astype(np.uint32)
        data, starts = tokenfiles.encode_blocks(ids)
        assert (tokenfiles.decode_blocks(data, starts) == ids).all()
        assert (tokenfiles.decode_blocks(data, starts[-1:]) == ids[-256:]).all()


# Sharding and chat


def test_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree, grown = sharding.uniform_tree(40), sharding.uniform_tree(41)
    rows = sharding.shard_documents(docs, tree, grown).collect()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in rows)
    assert 300 < sum(r["grown_shard"] == 40 for r in rows) < 700
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(350 < len(s) < 650 for s in by.values())
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 5 if x.shard == 0 else 1) for x in tree]
    moved = sharding.shard_documents(docs, tree, heavier).where("shard <> grown_shard").select("shard", "grown_shard").collect()
    assert all(r["grown_shard"] // 8 == 0 for r in moved)  # only into the region whose weight changed


def test_sharding_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs, sharding.uniform_tree(3)).collect()
    assert len(rows) == docs.count() and all(r["grown_shard"] is None for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {16} and {r["text_crc32"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert sharding.shard_documents(docs.limit(0), sharding.uniform_tree(3)).count() == 0
    with pytest.raises(ValueError):
        sharding.tree_shard(F.lit("a"), [sharding.Leaf(0, 0, 0, 0)])


def test_rotation(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|im_end|>"), (1, 2, None, None), (1, 2, "ann", "x"), (1, 2, "ann", "x"), (2, 0, "system", "s"), (None, 5, "eve", "e"), (1, None, "system", "first"), *[(3, i, "ab"[i % 2], f"t{i}") for i in range(300)]]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.rotate_perspectives(turns).collect()
    views = {}
    for r in rows:
        views.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "eve"), (3, "a"), (3, "b")}
    for (_, view), found in views.items():
        found.sort(key=lambda r: r["start_char"])
        text = "".join(r["rendered"] for r in found)
        assert found[-1]["end_char"] == len(text)
        for r in found:
            assert text[r["start_char"] : r["end_char"]] == r["rendered"]
            assert r["trained"] == (r["speaker"] == view) == (r["mask_start"] is not None)
            if r["trained"]:
                assert text[r["mask_start"] : r["mask_end"]].endswith("<|im_end|>") and r["rendered"].startswith("<|im_start|>assistant\n")
    assert len(views[(1, "ann")]) == 6 and views[(1, "ann")][0]["role"] == "system"
    assert "".join(r["rendered"] for r in views[(1, "bob")]).count("<|im_end|>") == 6
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(chat.rotate_perspectives(turns)).collect()}
    assert {k: r["text"] for k, r in whole.items()} == {k: "".join(r["rendered"] for r in found) for k, found in views.items()}
    assert all(r["text"][m["start"] : m["end"]].endswith("<|im_end|>") for r in whole.values() for m in r["masks"])
    ids = spark.createDataFrame([(None, 0, "a", "x"), ("", 0, "b", "y")], "conv_id string, turn long, role string, text string")
    assert {(r["conv_id"], r["perspective"]) for r in chat.rotate_perspectives(ids).collect()} == {(None, "a"), ("", "b")}
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


# Near duplicates


def shingles(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, least, of):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    links = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and of * len(a & b) >= least * len(a | b):
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}, links


@pytest.mark.parametrize("n,least,seed", [(3, 90, 1), (5, 80, 2), (1, 80, 3), (2, 60, 4)])
def test_join_equals_brute_force(spark, n, least, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([2, 8, 30, 150]))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=30)) for _ in range(20)] + ["", None, " ", "Aa", "aA", "a b", "A B"] + [rows[0]] * 5
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([*rows, (None, "a b c")], "doc_id long, text string")
    expected, links = brute_components(rows, n, least, 100)
    got = setjoin.jaccard_components(docs, n, least, 100).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(shingles(dict(rows)[r["doc_id"]], n)), expected[r["doc_id"]], links.get(r["doc_id"], 0))


def test_signatures_never_miss_a_link():
    rng = np.random.default_rng(5)
    for least in (60, 80, 90):
        parts = setjoin.Parts(least, 100)
        for _ in range(400):
            n = int(rng.integers(1, 200))
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            other = np.unique(np.concatenate((base[rng.random(len(base)) > rng.random() * 0.3], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
            if len(other):
                shared = len(np.intersect1d(base, other))
                if 100 * shared >= least * (len(base) + len(other) - shared):
                    (one, needs), (two, others) = parts.signatures(base), parts.signatures(other)
                    level = parts.starts.index(max(x for x in parts.starts if x <= min(len(base), len(other))))
                    both = np.intersect1d(one, two)
                    assert (both & np.uint64(127) == level).sum() >= max(dict(needs)[level], dict(others)[level]) >= 1


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP_TOKENS", 300)
    monkeypatch.setattr(setjoin, "QUERY_TOKENS", 500)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    expected, links = brute_components(rows, 2, 90, 100)
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 90, 100).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in got} == {i: (expected[i], links.get(i, 0)) for i, _ in rows}


def test_join_of_an_empty_table(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (1, 2), (3, 3), (2, 1), *[(100, i) for i in range(101, 160)], *[(200 + i, 201 + i) for i in range(70)]], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert [found[i] for i in (9, 8, 7, 6, 1, 2)] == [6, 6, 6, 6, 1, 1] and 3 not in found
    assert {found[i] for i in range(100, 160)} == {100} and {found[i] for i in range(200, 271)} == {200}


def brute_lines(rows, min_words=linededup.MIN_WORDS):
    lines = []
    for i, text in sorted(rows):
        lines += [(i, k, line.strip(" \t\r")) for k, line in enumerate((text or "").split("\n")) if line.strip(" \t\r")]

    def near(a, b):
        a, b = a.split(), b.split()
        if min(len(a), len(b)) < min_words or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    gone = set()
    for k, (i, n, line) in enumerate(lines):
        if any(x[2] == line or near(x[2], line) for x in lines[:k]):
            gone.add((i, n))
    return gone


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    pool = [rng.choices(vocabulary, k=rng.choice([1, 3, 8, 9, 20])) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            change = rng.random()
            if change < 0.25:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            elif change < 0.4:
                line.insert(rng.randrange(len(line) + 1), rng.choice(vocabulary))
            elif change < 0.5 and len(line) > 1:
                del line[rng.randrange(len(line))]
            lines.append(" " * rng.randint(0, 1) + " ".join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n \n")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    expected = brute_lines(rows)
    assert {(r["doc_id"], r["line_no"]) for r in linededup.duplicate_lines(docs).collect()} == expected
    kept = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert linededup.dedup_lines(docs).columns == docs.columns
    for i, text in rows:
        left = [line for k, line in enumerate((text or "").split("\n")) if (i, k) not in expected]
        lost = any(d == i for d, _ in expected)
        if lost and not any(line.strip() for line in left):
            assert i not in kept
        else:
            assert kept[i]["text"] == ("\n".join(left) if lost else text) and kept[i]["n_chars"] == len(kept[i]["text"] or "")


@pytest.mark.parametrize("min_words", [1, 3])
def test_short_lines_with_a_smaller_bound(spark, min_words):
    rng = random.Random(min_words)
    rows = [(i, "\n".join(" ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=rng.randint(1, 6))) for _ in range(rng.randint(0, 3)))) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in linededup.duplicate_lines(docs, min_words).collect()} == brute_lines(rows, min_words)


def test_orders_of_one_bag_of_words_are_not_paired(spark):
    rng = random.Random(2)
    bag = [f"w{i}" for i in range(9)] + ["twice", "twice"]
    rows = [(i, " ".join(rng.sample(bag, 11) + (["more"] if i % 2 else []))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in linededup.duplicate_lines(docs).collect()} == brute_lines(rows)


def test_columns_of_clashing_names_pass(spark):
    names = ["gone", "docloom_kept", "kept", "row", "hit", "doc", "id", "score", "predicted", "docloom_key", "_maybe", "component", "copies"]
    line = "one line of more than eight words is here twice"
    rows = [(i, f"{line}\nand line {i} of its own", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert kept[0]["text"] == rows[0][1] and kept[3]["text"] == "and line 3 of its own"
    assert all(kept[i][n] == f"{n}{i}" for i in range(4) for n in names)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels), keep_columns=True, score_name="docloom_score", predicted_name="docloom_predicted")
    assert {r["score"] for r in scored.collect()} == {f"score{i}" for i in range(4)}
    for name, stage in corpus_pipeline.STAGES[:3]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns, name
        assert all(r[n].startswith(n) for r in made.collect() for n in names), name


def test_a_document_of_very_many_lines(spark):
    text = "\n".join(f"line {i % 30_000}" for i in range(60_000))
    [row] = linededup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["text"] == "\n".join(f"line {i}" for i in range(30_000))


def test_lines_of_odd_documents(spark):
    gone = linededup.duplicate_lines(odd_documents(spark)).collect()
    assert {(r["doc_id"], r["line_no"]) for r in gone} == {(7, 0), (9, 0), (11, 2)} or {(7, 0), (9, 0), (11, 2)} <= {(r["doc_id"], r["line_no"]) for r in gone}
    assert linededup.duplicate_lines(odd_documents(spark).limit(0)).count() == 0


def plain_hash(data):
    """The hash of a chunk, byte by byte with Python's integers."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    total = sum(mix((b + 1) * base & full) * pow(base, k, 1 << 64) for k, b in enumerate(data))
    return mix((total + len(data) * 0x94D049BB133111EB) & full), mix(total & full)


def plain_fingerprint(text):
    """Chunks found by going through the bytes one at a time."""
    data, letters = text.encode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    block = 1
    while block * 64 < len(data):
        block *= 2

    def chunks(size):
        found, start = [], 0
        for k in range(7, len(data) + 1):
            if plain_hash(data[k - 7 : k])[1] % size == size - 1:
                found.append(data[start:k])
                start = k
        return found, data[start:]

    while block > 1 and len(chunks(block)[0]) < 32:
        block //= 2

    def signature(size, length):
        found, rest = chunks(size)
        if len(found) > length - 1:
            rest = b"".join(found[length - 1 :]) + rest
        return "".join(letters[plain_hash(c)[0] >> 58] for c in [*found[: length - 1], rest] if c)

    return f"{block}:{signature(block, 64)}:{signature(2 * block, 32)}"


def plain_likeness(a, b):
    """Edit distance by the whole table, insertions and deletions costing one."""
    (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
    if a == b:
        return 1.0

    def of(x, y):
        if not any(x[i : i + 4] in y for i in range(len(x) - 3)):
            return 0.0
        table = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i][j] = table[i - 1][j - 1] if x[i - 1] == y[j - 1] else 1 + min(table[i - 1][j], table[i][j - 1])
        return 1 - table[-1][-1] / (len(x) + len(y))

    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a1, b2)], -1: [(a2, b1)]}
    return max((of(x, y) for x, y in pairs.get(int(p).bit_length() - int(q).bit_length(), [])), default=0.0)


def test_fingerprints_equal_plain_code():
    rng = random.Random(12)
    texts = ["", "a", "short", "é" * 40, "z" * 900] + ["".join(rng.choices("abcdefghij klmnop", k=rng.randint(5, 3000))) for _ in range(25)]
    texts += [t[: len(t) // 2] + "changed" + t[len(t) // 2 :] for t in texts[-10:]]
    marks = [fingerprint.fingerprint(t) for t in texts]
    assert marks == [plain_fingerprint(t) if t else "1::" for t in texts]
    pairs = [(a, b) for i, a in enumerate(marks) for b in marks[i : i + 12]] + list(zip(marks[-20:-10], marks[-10:], strict=True))
    assert all(abs(fingerprint.likeness(a, b) - plain_likeness(a, b)) < 1e-12 for a, b in pairs)


def test_fingerprints(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = fingerprint.fingerprint_documents(docs).orderBy(F.desc("doc_id")).collect()
    texts = [r["text"] or "" for r in docs.orderBy(F.desc("doc_id")).collect()]
    for k, r in enumerate(rows):
        edited = fingerprint.edited_text(texts[k], texts[(k + 1) % len(texts)])
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.fingerprint(texts[k]), fingerprint.fingerprint(edited))
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], rows[(k + 1) % len(rows)]["fingerprint"])
    one = fingerprint.fingerprint_documents(docs.where("doc_id = 6")).first()
    assert one["edited_sha256"] == hashlib.sha256(fingerprint.edited_text(LONG, LONG).encode()).hexdigest()
    assert fingerprint.fingerprint_documents(docs.limit(0)).count() == 0


def test_likeness_follows_edits(spark):
    texts = [r["text"] for r in documents(spark).collect() if len(r["text"]) > 400]
    near = [fingerprint.likeness(fingerprint.fingerprint(t), fingerprint.fingerprint(t[:200] + "inserted words " + t[200:])) for t in texts]
    apart = [fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) for a, b in zip(texts, texts[1:], strict=False) if a[:50] != b[:50]]
    assert np.mean(near) > 0.85 and np.mean(apart) < 0.1
    assert fingerprint.likeness(fingerprint.fingerprint(LONG), fingerprint.fingerprint(LONG)) == 1.0


# Vectors and quality


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 16)).round(3)
    x[700:760] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] + [0.0] * 14), (5200, [1.0]), (5250, [2.0]), (5300, [-1.0]), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1200, 50):
        score = unit @ unit[q]
        score[q] = -9
        best = sorted(range(1200), key=lambda i: (-round(score[i], 12), i))[:5]
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(score[g[1]] - g[2]) < 1e-12 for g in got) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        hits += len({g[1] for g in got} & set(best))
    assert found.pop(5200) == [(1, 5250, 1.0), (2, 5300, -1.0)] and found.pop(5250)[0][1] == 5200 and len(found.pop(5300)) == 2
    assert set(found) == set(range(0, 1200, 50)) and hits / (5 * len(found)) >= 0.9
    assert [g[1] for g in sorted(found[700])] == [3, 701, 702, 703, 704]
    few = ann.nearest_neighbours(vectors.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.nearest_neighbours(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 300)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 24)) + 2 * rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -9
    best = np.argsort(-near, axis=1, kind="stable")[:, :5]
    found = {}
    for r in ann.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([g[0] for g in sorted(f)] == [1, 2, 3, 4, 5] for f in found.values()) and len(found) == 60
    assert all(abs(near[q // 50, v] - s) < 1e-12 for q, f in found.items() for _, v, s in f)
    assert sum(len({g[1] for g in f} & set(best[q // 50])) for q, f in found.items()) / 300 >= 0.9


def test_seeded_bounds_lose_nothing():
    rng = np.random.default_rng(13)
    x, ids = rng.standard_normal((900, 12)), np.arange(900)
    x[400:420] = x[5]
    bounds, row, column, score = ann.seed_bounds(x[:30], ids[:30], x[300:500], ids[300:500], 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(30):
        near = unit[300:500] @ unit[q]
        assert np.isclose(bounds[q], 2 - 2 * np.sort(near)[-5])
        assert np.allclose(np.sort(score[row == q]), np.sort(near)[-5:])
    rotation = np.eye(12)
    plain = ann.scan_list(x, ids, x[:30], ids[:30], rotation, 5)
    seeded = ann.scan_list(x, ids, x[:30], ids[:30], rotation, 5, bounds)
    truth = np.sort(unit[:30] @ unit.T - 9 * np.eye(900)[:30], axis=1)[:, -5:]
    assert np.mean([len({p[1] for p in plain if p[0] == q} & {p[1] for p in seeded if p[0] == q}) / 5 for q in range(30)]) >= 0.95
    assert np.mean([np.isclose(s, truth[q], atol=1e-9).any() for q, _, s in seeded]) >= 0.95
    few = ann.seed_bounds(x[:2], ids[:2], x[:3], ids[:3], 5)
    assert np.isinf(few[0]).all() and len(few[1]) == 4


def test_neighbours_with_repeated_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12, 8))
    x[1] = x[0] + 0.01
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1, [float(v) for v in x[1]])] * 40 + [(2, [float(v) for v in -x[0]])] * 9
    ids, members = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    unit = members / np.linalg.norm(members, axis=1, keepdims=True)
    score = {}
    for i, s in zip(ids, unit @ unit[0], strict=True):
        score[int(i)] = max(score.get(int(i), -9), s)
    best = sorted((i for i in score if i), key=lambda i: -score[i])[:5]
    found = ann.scan_list(members, ids, members[:1], ids[:1], np.eye(8), 5)
    assert [f[1] for f in found] == best and np.allclose([f[2] for f in found], [score[i] for i in best])
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(vectors, F.col("vec_id") == 0).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5] and got[0][1] == 1 and len({g[1] for g in got}) == 5


def plain_tokens(text):
    """Slots of a text's tokens, found sign by sign."""
    found, kinds = [], []
    for b in (text or "").encode():
        c = chr(b)
        kind = 0 if b in (0x20, *range(0x09, 0x0E)) else 1 if c.isascii() and c.isalnum() or b > 127 else 2
        if kind and kinds and kinds[-1] == kind:
            found[-1].append(b)
        elif kind:
            found.append([b])
        kinds.append(kind)
    return [plain_hash(bytes(t).lower())[0] % quality.SLOTS for t in found]


def test_quality_equals_plain_code(spark):
    texts = ["One two two!", "", None, "a, b; one two", "1.5 É x", "two " * 30, "line\nline two\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index, tokens = quality.index_matrix(), [plain_tokens(t) for t in texts]
    assert {tuple(np.unique(np.abs(r).sum())) for r in index[:50]} and (np.abs(index).sum(axis=1) <= quality.NONZERO).all()
    sums = np.zeros((quality.SLOTS, quality.WIDTH))
    for slots in tokens:
        for a, b in zip(slots, slots[1:], strict=False):
            sums[a] += index[b]
            sums[b] += index[a]
    contexts = quality.corpus_contexts(docs.repartition(3))
    norms = np.linalg.norm(sums, axis=1)
    assert np.allclose(contexts, sums / np.maximum(norms, 1e-6)[:, None], atol=1e-6)
    vectors = np.concatenate([index, contexts], axis=1)
    x = quality.pooled(pa.array(texts), vectors)
    for row, text, slots in zip(x, texts, tokens, strict=True):
        data = (text or "").encode()
        mean = np.mean([vectors[s] for s in slots], axis=0) if slots else np.zeros(vectors.shape[1])
        lines, capitals = data.count(b"\n"), sum(65 <= b <= 90 for b in data)
        signs = sum(33 <= b < 127 and not chr(b).isalnum() for b in data)
        shape = [np.log1p(len(slots)), np.log1p(len(data)), np.log1p(lines), *(v / max(1, len(data)) for v in (len(slots), lines, capitals, signs))]
        assert np.allclose(row, [*mean, *shape], atol=1e-6), text
    net = quality.fit_network(x, np.array([1, 0, 0, 1, 1, 0, 1], float))
    for row, score in zip(x, net.score(x), strict=True):
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [np.tanh(sum(v * w for v, w in zip(z, column, strict=True)) + b) for column, b in zip(net.first.T, net.first_bias, strict=True)]
        logit = sum(h * w for h, w in zip(hidden, net.second, strict=True)) + net.second_bias
        assert abs(score - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([r["predicted"] for r in good]) > 0.98 and np.mean([1 - r["predicted"] for r in bad]) > 0.7
    assert np.mean([g["score"] > b["score"] for g in good for b in bad]) > 0.95


def test_quality_of_odd_documents(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
    alone = quality.fit_quality(docs, labels.limit(0))
    assert quality.score_quality(docs, alone).where("score <> 0.5").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


# Queries and the pipeline


def test_queries_with_sql(spark):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        found = queries()[name](spark, DATA)
        names = sorted(found.columns)
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == names
        assert sorted(tuple(str(r[c]) for c in names) for r in found.collect()) == sorted(tuple(str(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark)
    (_, keep), (_, lines), (_, join), (_, _) = corpus_pipeline.STAGES
    good = keep(spark, docs, DATA)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    deduped = lines(spark, docs, DATA)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_lines(rows)
    for r in deduped.collect():
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if (r["doc_id"], k) not in expected)
    left = join(spark, docs, DATA)
    components, _ = brute_components(rows, 5, 80, 100)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(components.values())
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert check_packed(packed, 4096) <= sum(r["length"] for r in packed) / 4096 + 2
    # The chain: what plain Python makes of the first stage's rows.
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    gone, made = brute_lines(rows), []
    for i, text in rows:
        left = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
        if len(left) == len(text.split("\n")) or any(x.strip(" \t\r") for x in left):
            made.append((i, "\n".join(left)))
    components, _ = brute_components(made, 5, 80, 100)
    tokenizer = words.hf_tokenizer(P.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for i, text in made if components.get(i, i) == i}
    expected = {(i, k, zlib.crc32(np.array(x[k * 4096 : k * 4096 + 4096], "<u4").tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096))}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed} == expected


def test_stages_of_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, DATA)
        assert made.count() and (made.columns == odd.columns or name == "best-fit packing"), name
        assert stage(spark, odd.limit(0), DATA).count() == 0, name


def test_near_duplicates_are_judged_by_row(spark):
    import corpus_pipeline

    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(3, x), (7, x), (7, y), (8, z), (8, z), (None, z + " more"), (None, "alone in its words"), (9, "twice the same"), (9, "twice the same"), (10, ""), (11, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert left.columns == docs.columns
    expected = [(3, x), (7, y), (8, z), (None, "alone in its words"), (9, "twice the same"), (10, ""), (11, None)]
    assert sorted((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] and r["text"]) == sorted(e for e in expected if e[0] and e[1])
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == sorted(map(str, expected))
