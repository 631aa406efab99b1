"""Each corpus operator against brute force, and on awkward tables: nulls, empty and very long texts, repeated rows,
no rows at all, and columns whose names clash with its own."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coordwave.llm import byte_bpe, chat, language, mixing, plane_files, quality, queries, simhash, suffix_dedup, suffix_sort, top_k, toxicity
from coordwave.llm.common import free_name, table

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    rng = random.Random(7)
    words = ["alpha", "Beta", "γάμμα", "delta!", "ein", "zwölf", "<tag>", "x" * 30, "了解", "\x1c", "'s"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(24)]
    shared = "this passage of well over fifty bytes stands in several documents, word for word. "
    texts = [*prose, None, "", "   \n\t ", "a", "ab cd", "line\nline\nline\n", "na " * 120, shared + prose[0], prose[1] + shared, shared * 3, prose[2], prose[2], "é" * 40, "\\### Assistant: </turn>", "end <|endoftext|>of<|startoftext|> and <|ENDOFTEXT|> Text", " lead", "trail ", "two  spaces \n\n", "very long " + " ".join(str(i * i) for i in range(30000))]
    rows = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id " * 20, None, None, None), (None, None, "en", "s", 0), (900, "é" * 40 + "ü" * 9, "de", None, 3), (-5, shared, "en", "s", 1)]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 1), (7777, 1, 0)], "doc_id long, quality int, toxic int")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_repeats(rows, span=50):
    first, marks = {}, {}
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t, *_ in named:
        data = (t or "").encode()
        for p in range(len(data) - span + 1):
            first.setdefault(data[p : p + span], i)
    out = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        mark = bytearray(len(data))
        if i is not None:
            for p in range(len(data) - span + 1):
                if first[data[p : p + span]] < i:
                    mark[p : p + span] = b"\1" * span
        kept = bytes(c for c, m in zip(data, mark) if not m)
        spans = sum(1 for p in range(len(data)) if mark[p] and (p == 0 or not mark[p - 1]))
        out.append((i, len(data), sum(mark), spans, sha(kept)))
    return out


def test_repeats_equal_brute_force(awkward):
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(awkward).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(awkward_rows()), key=repr)


def test_repeats_with_other_spans(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (suffix_dedup.HOT_BYTES, 60, 0):  # no hash, some, and all are split
        got = sorted((r.doc_id, r.repeats.n_bytes, r.repeats.n_removed, len(r.repeats.spans), sha(bytes(r.repeats.kept))) for r in suffix_dedup.remove_repeats(docs, span=9, gram=4, hot=hot).collect())
        assert got == sorted(brute_repeats(rows, 9))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for k in range(400):
        text = np.append(rng.integers(1, rng.integers(2, (6, 300, 70_000)[k % 3]), rng.integers(1, 60)), 0)
        order = suffix_sort.suffix_array(text)
        plain = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain
        shared = suffix_sort.common_prefixes(text, order)
        for a, b in zip(plain, plain[1:]):
            x, y = text[a:].tolist(), text[b:].tolist()
            assert shared[b] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_suffix_array_recurses_on_many_names(monkeypatch):
    """Induced sorting all the way down, for a string with tens of thousands of different names."""
    rng, sizes, induction = np.random.default_rng(2), [], suffix_sort._Induction
    monkeypatch.setattr(suffix_sort, "_Induction", lambda t, *x: sizes.append((len(t), x[-1])) or induction(t, *x))
    part = rng.integers(1, 30, 60_000)
    text = np.concatenate((part, part[7:], np.full(500, 3), part[:20_000], [0]))
    order = suffix_sort.suffix_array(text)
    data = (text.astype(">u2")).tobytes()
    assert all(data[2 * a : 2 * a + 200] <= data[2 * b : 2 * b + 200] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))
    assert sorted(order.tolist()) == list(range(len(text))) and len({n for n, _ in sizes}) > 3 and max(s for _, s in sizes) > 10_000
    shared = suffix_sort.common_prefixes(text, order)
    rank = np.argsort(order)
    for b in rng.integers(0, len(text), 300).tolist():
        if rank[b]:
            a, k = int(order[rank[b] - 1]), int(shared[b])
            assert (text[a : a + k] == text[b : b + k]).all() and text[a + k] < text[b + k]


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    """nodes: (id, fingerprint); the least id that links of two bits or fewer reach."""
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in nodes:
        for j, g in nodes:
            if (f ^ g).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in nodes}


def test_simhash_equals_brute_force(awkward):
    wanted = [(r[0], brute_fingerprint(r[1])) for r in awkward_rows()]
    group = brute_components([w for w in wanted if w[0] is not None])
    by_print = {f: group[i] for i, f in wanted if i is not None}
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.fingerprint_table(awkward).collect()), key=repr)
    assert got == sorted(((i, f"{f:016x}", by_print.get(f)) for i, f in wanted), key=repr)


def test_gray_index_with_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE", 40)
    rng = np.random.default_rng(5)
    base, prints = rng.integers(0, 2**63, 3, dtype=np.uint64), set()
    for _ in range(600):
        f = int(base[rng.integers(3)])
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(bit)
        prints.add(f)
    nodes = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in nodes], "fp long, rep long")
    roots = {r.u: r.v for r in simhash.components(simhash.links(frame)).collect()}
    assert {i: roots.get(i, i) for i, _ in nodes} == brute_components(nodes)


def test_descent_adds_up_differences(monkeypatch):
    """Pairs within two bits are found, each once, and most pairs of nodes go with all that is below them."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for _ in range(4)]]))
    gray = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(shift)
    fp = fp[np.argsort(gray)]
    group = np.repeat([0, 1, 2], [len(fp) - 300, 299, 1])
    levels = simhash._hierarchy(group, fp)
    assert len(levels[-1].first) == 3 and len(levels) > 3
    for low, high in zip(levels, levels[1:]):
        for k in range(len(high.first)):
            below = slice(high.first[k], high.end[k])
            assert (low.fixed[below] | high.fixed[k] == low.fixed[below]).all() and ((low.pattern[below] ^ high.pattern[k]) & high.fixed[k] == 0).all()
    monkeypatch.setattr(simhash, "PAIRS", 100)
    a, b = simhash._descend(levels, 2)
    got = sorted((min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()))
    assert got == [(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 2]


def test_popular_fingerprints(awkward, monkeypatch):
    plain = sorted(map(repr, simhash.fingerprint_table(awkward).collect()))
    monkeypatch.setattr(simhash, "HOT_ROWS", 1)
    assert sorted(map(repr, simhash.fingerprint_table(awkward).collect())) == plain


def test_keep_first_keeps_one_of_each_group(awkward):
    awkward = awkward.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    kept = simhash.keep_first(awkward)
    ids = [r.doc_id for r in kept.collect()]
    table = simhash.fingerprint_table(awkward).collect()
    wanted = {r.component_id for r in table if r.component_id is not None}
    nameless = {r.fingerprint for r in table if r.component_id is None}
    named = [i for i in ids if i is not None]
    assert kept.columns == awkward.columns and len(named) == len(set(named)) and set(named) == wanted
    assert nameless and len(ids) - len(named) == len(nameless)


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_equals_brute_force(awkward, labels):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(awkward, labels).collect()), key=repr)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in awkward_rows()), key=repr)


def test_quality_scores_are_mean_log_ratios(awkward, labels):
    ratios = quality.log_ratios(awkward, labels)
    found = quality.verdicts(awkward, labels).collect()

    def bucket(*words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return (h - 2**64 if h >> 63 else h) % len(ratios)

    grams = {}
    raw, good = Counter(), Counter()
    marked = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    for i, t, *_ in awkward_rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:])]
        grams[t] = g
        raw.update(g)
        if i in marked:
            good.update(g)
    share = sum(good.values()) / sum(raw.values())
    for b in (0, 17, *list(raw)[:20]):
        assert abs(ratios[b] - np.log((good[b] + quality.SMOOTHING) / (share * raw[b] + quality.SMOOTHING))) < 1e-9
    text = {r[0]: r[1] for r in awkward_rows() if r[0] is not None}
    for r in found:
        if r.doc_id is not None and grams[text[r.doc_id]]:
            mean = float(np.mean([ratios[b] for b in grams[text[r.doc_id]]]))
            assert abs(r.score - mean) < 1e-9 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_buckets_grow_with_the_corpus(spark, awkward):
    assert quality.buckets_for(awkward) == quality.buckets_for(awkward.limit(0)) == quality.LEAST_BUCKETS
    long = spark.range(10).select(F.repeat(F.lit("x" * 1000), 200_000).alias("text"))
    assert quality.buckets_for(long) == 1 << 16


def test_good_ids_beyond_the_broadcast(awkward, labels, monkeypatch):
    few = quality.log_ratios(awkward, labels)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 3)
    assert quality.log_ratios(awkward, labels) == few


def test_quality_keeps_clean_documents_out_of_the_sample(spark, small):
    """On the smallest table, good documents stay and most bad ones go."""
    base = small.replace("sf0.001", "sf0.01")
    kept = {r.doc_id for r in quality.keep_good(table(spark, base, "documents"), quality.log_ratios(table(spark, base, "documents"), table(spark, base, "labels"))).select("doc_id").collect()}
    failed = {r.doc_id for r in queries.op4_ngram_ratio_quality(spark, base).where("base_failed").collect()}
    good = {r.doc_id for r in table(spark, base, "labels").where("quality = 1").collect()} - failed
    bad = {r.doc_id for r in table(spark, base, "labels").where("quality = 0").collect()}
    assert len(good & kept) == len(good) and len(bad & kept) < 0.1 * len(bad)


def test_byte_bpe_equals_library(awkward):
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t, *_ in awkward_rows():
        ids = library.encode_ordinary(t or "")
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode_bytes(ids))))
    got = [tuple(r) for r in byte_bpe.digest(awkward, BYTE_BPE, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_transducer_on_random_text_and_full_tables():
    ranks = byte_bpe.read_ranks(BYTE_BPE)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    own.transducer.most_states = 500  # tables are dropped often, in the middle of pieces too
    for size in (1, 50, 2000):
        word = "".join(random.Random(size).choice("abcdefgh") for _ in range(size))
        assert own.transducer.encode_piece(word.encode()) == library.encode_ordinary(word)
    rng = random.Random(11)
    letters = [chr(i) for i in range(1, 0x250)] + list("漢字かな한국어😀́  \n\n '")
    for k in range(3000):
        s = "".join(rng.choice(letters if k % 2 else "abeghinorst ly'\n,") for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(own.encode(s), np.int32).tolist()
        assert ids == library.encode_ordinary(s) and "".join(own.decode(ids, block=1)) == s


def test_utf8_machine_waits_for_cut_characters():
    machine, text = byte_bpe.Utf8Machine(), "aé了😀z"
    assert "".join(machine.feed(bytes([b])) for b in text.encode()) + machine.finish() == text
    assert machine.feed(b"\xff\xe4") == "�" and machine.finish() == "�"
    rng = random.Random(8)
    for _ in range(3000):
        data = bytes(rng.choice([rng.randrange(256), 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0x9F, 0xA0, 65]) for _ in range(rng.randint(0, 8)))
        machine = byte_bpe.Utf8Machine()
        assert machine.feed(data) + machine.finish() == data.decode("utf-8", "replace")


def test_plane_files_equal_library(awkward):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = sorted(((i, t) for i, t, *_ in awkward_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, wanted = 0, []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in plane_files.digest(awkward, WORD_BPE).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_words_with_special_tokens_equal_library():
    tokenizer, own, rng = Tokenizer.from_file(WORD_BPE), plane_files.WordEncoder(WORD_BPE), random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "A", "bc", " ", "\n", "é", "'S", "1", "."]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        counts, ids = own.encode([text], 1)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    path = tmp_path / "x"
    with open(path, "wb") as f:
        writer, want = plane_files.Writer(f, block=64, bits=bits), []
        for k in range(30):
            counts = rng.integers(0, 40, 3)
            ids = rng.integers(0, 2**32, counts.sum(), dtype=np.uint32)
            writer.append([k, None, -k], counts, ids)
            want += ids.tolist()
        writer.close()
    with open(path, "rb") as f:
        read = list(plane_files.read_file(f, path.stat().st_size))
    assert np.concatenate([r[2] for r in read]).tolist() == want and [d for r in read for d in r[0]] == [d for k in range(30) for d in (k, None, -k)]


def test_cut_file_is_refused(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"IDPLANE1" + b"0" * 100)
    with open(path, "rb") as f, pytest.raises(ValueError):
        next(plane_files.read_file(f, 108))


def test_top_k_equals_sql_and_handles_ties(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{small}/embeddings.parquet'")
    assert sorted(map(tuple, top_k.nearest(table(spark, small, "embeddings")).collect())) == sorted(con.sql(top_k.ORACLE).fetchall())
    rows = [(i, [1.0, float(i % 2)]) for i in range(150)] + [(200, None), (201, [None, 1.0]), (202, [float("nan"), 1.0]), (203, [1.0]), (204, []), (None, [1.0, 1.0])]
    got = defaultdict(list)
    for r in top_k.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(i, 1024**2) for i in range(1, 11)] and got[100] == [(i, 1024**2) for i in range(10)] and set(got) == {0, 100}
    assert top_k.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_top_k_with_repeated_ids_and_huge_scores(spark):
    """Rows that repeat an id are queries and candidates of their own; a few huge components don't change an order."""
    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 100, 100, 7, 8, 9, 10**9]), [rng.choice([0.5, -2.0, 1.25, 3.0]) for _ in range(rng.choice([2, 3]))]) for _ in range(60)]
    for extra in ([], [(3, [1e18, 1.0]), (200, [1e18, -1.0, 1.0]), (4, [-1e18, 1.0]), (200, [3e200, -1.0])]):
        table = rows + extra
        got = Counter(tuple(r) for r in top_k.nearest(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect())
        whole = [[int(np.floor(1024 * x)) for x in v] for _, v in table]
        wanted = Counter()
        for q, (i, _) in enumerate(table):
            if i % 100 == 0:
                best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), table[c][0]) for c in range(len(table)) if c != q)[:10]
                wanted.update((i, n + 1, v, max(-(2**63), min(2**63 - 1, -s))) for n, (s, v) in enumerate(best))
        assert got == wanted


def test_chat_equals_sql_and_reads_back(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{small}/conversations.parquet'")
    assert sorted(map(tuple, chat.digest(table(spark, small, "conversations")).collect())) == sorted(con.sql(chat.ORACLE).fetchall())
    turns = [("a\\n\nb###</turn>\\", "x\n</turn>\n### user\n\\\\###"), ("", ""), ("assistant", "\\"), ("assistant", "### ")]
    made = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id long, turns array<struct<role: string, text: string>>")
    read = chat.format_turns(made).select("id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("l")).orderBy("id").collect()
    assert [tuple(t) for t in read[0].t] == turns and read[0].l == "\\### " and read[1].t == [] and read[2].t is None


def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"human","content":"a"},{"content":null,"role":"x"}]}', '{"instruction":"i","input":"","output":"o"}', '{"prompt":"p","completion":"c"}', '{"conversations":[{"from":"gpt","value":"v"}]}', '{"x":1}', "nope", None, "[]"]
    got = chat.turns_of_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"), "conv_id", "record").orderBy("id").collect()
    assert [r.layout for r in got] == ["messages", "instruction-input", "prompt-completion", "from-value", None, None, None, None]
    assert [tuple(t) for t in got[0].turns] == [("user", "a"), ("x", "")] and [tuple(t) for t in got[1].turns] == [("user", "i"), ("assistant", "o")]
    with pytest.raises(ValueError):
        chat.canonical([spark.range(1)])


def test_chat_layouts_with_other_and_deeper_fields(spark):
    """Fields that no mapping uses change nothing; a record that no mapping covers is told, not emptied."""
    records = [
        '{"id":1,"source":{"a b":{"c:d":[1]}},"messages":[{"role":"human","content":"a","name":"n"}]}',
        '{"messages":[{"role":"user","content":[{"type":"text","text":"x"},{"type":"image","url":{"u":1}},{"type":"text","text":"y"}]}],"n":[[{"z":1}]]}',
        '{"instruction":"i","output":"o","score":0.5}',
        '{"messages":[],"id":2}',
        '{"messages":[{"role":"u","content":"s"},{"role":"u","content":["t"]}]}',
        '{"messages":[{"role":"u","content":{"parts":["s"]}}]}',
        '{"messages":[{"role":"u","content":"s"}],"prompt":"p"}',
    ]
    frame = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = chat.turns_of_records(frame, "conv_id", "record").orderBy("id").collect()
    assert [r.layout for r in got] == ["messages", "message-parts", "instruction", "no-messages", None, None, None]
    assert [None if r.turns is None else [tuple(t) for t in r.turns] for r in got] == [[("user", "a")], [("user", "x\ny")], [("user", "i"), ("assistant", "o")], [], None, None, None]
    assert chat.format_turns(got_frame := chat.turns_of_records(frame, "conv_id", "record")).where("formatted IS NULL").count() == 3 and got_frame.count() == 7
    with pytest.raises(Exception, match="no layout has the fields of a record: messages"):
        chat.canonical([frame]).collect()
    paths = frame.select(chat.record_paths(F.col("record")).alias("p")).collect()
    assert sorted(paths[0].p) == ["id", "messages[].content", "messages[].name", "messages[].role", "source.a b.c:d[]"]
    assert "n[][].z" in paths[1].p and "messages[].content[].url.u" in paths[1].p and "messages[].content?" in paths[4].p
    assert [r.f for r in frame.select(chat.record_fingerprints(F.col("record")).alias("f")).collect()] == [chat.fingerprint(r.p) for r in paths]


def test_chat_rows_with_nulls(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", None), (1, None, None, "q"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(rows).collect()}
    assert got[1].turns_sha256 == sha("\nq\nassistant\n\n") and got[1].loss_chars == 0 and got[None].n_turns == 1 and got[-7].loss_chars == len(chat.PROBE)
    assert [r.conv_id for r in chat.digest(rows.limit(0)).collect()] == [-7]


def test_languages(spark, small):
    truth = {r.doc_id: r.lang for r in table(spark, small, "documents").collect()}
    found = queries.op5_bitmask_language(spark, small).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(truth) and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)


def plain_grams(text):
    """The four-byte n-grams of a text in lower case, runs of white space and other ASCII non-letters as one blank."""
    data = b" " + text.lower().encode() + b" "
    kept = bytearray()
    for k, b in enumerate(data):
        letter = b >= 128 or 97 <= b <= 122
        if letter or k == 0 or data[k - 1] >= 128 or 97 <= data[k - 1] <= 122:
            kept.append(b if letter else 32)
    return [bytes(kept[k : k + 4]) for k in range(len(kept) - 3)]


def gram_hash(gram):
    h = int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 % 2**64
    return h ^ h >> 29


def test_languages_equal_plain_filters(spark, small):
    """Filters and verdicts from their definition, with sets and one n-gram at a time."""
    docs = table(spark, small, "documents").select("doc_id", "text", "lang")
    texts = language.training_texts(docs)
    counts = defaultdict(Counter)
    for text, lang in texts:
        counts[lang].update(gram_hash(g) for g in plain_grams(text))
    names = sorted(counts)
    share = {x: {h: n / counts[x].total() for h, n in counts[x].items()} for x in names}
    slots = lambda h: [(h >> 20 * k) % language.SLOTS for k in range(language.PROBES)]
    bits = {x: set() for x in names}
    for x in names:
        typical = [h for h in share[x] if share[x][h] > language.RATIO * sum(share[y].get(h, 0) for y in names if y != x) / (len(names) - 1)]
        for h in sorted(typical, key=lambda h: (-share[x][h], h))[: language.KEPT]:
            bits[x].update(slots(h))
    filters = language.fit(texts)
    assert filters.languages == tuple(names)
    for k, x in enumerate(names):
        assert set(np.flatnonzero(filters.slices[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).tolist()) == bits[x]
    wrong = {x: (len(bits[x]) / language.SLOTS) ** language.PROBES for x in names}
    for r in language.identify(docs.limit(60), filters).collect():
        grams = [gram_hash(g) for g in plain_grams(r.text or "")]
        if not any(map(str.isalpha, r.text or "")):
            assert r.language.lang == "und"
            continue
        found = {x: sum(all(s in bits[x] for s in slots(h)) for h in grams) / len(grams) for x in names}
        fixed = {x: min(1, max(0, (found[x] - wrong[x]) / (1 - wrong[x]))) for x in names}
        best = max(names, key=lambda x: (fixed[x], [-ord(c) for c in x]))
        assert r.language.lang == best and abs(r.language.score - fixed[best]) < 1e-9


def test_too_many_labels_are_told(spark):
    rows = spark.range(300).selectExpr("id AS doc_id", "'some text here' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        mixing.mix(rows, "lang")


def test_posteriors_equal_plain_bayes(spark, small):
    """The classifier and its posteriors from their definition."""
    docs = table(spark, small, "documents")
    texts = mixing.training_texts(docs, "lang")
    bucket = lambda g: gram_hash(g) >> 13 & mixing.FEATURES - 1
    names = sorted({d for _, d in texts})

    def logs(rows):
        seen = {d: Counter() for d in names}
        for t, d in rows:
            seen[d].update(map(bucket, plain_grams(t)))
        return {d: (lambda f, d=d: np.log((seen[d][f] + 0.5) / (seen[d].total() + 0.5 * mixing.FEATURES))) for d in names}

    def posterior(scale, log, text):
        grams = [bucket(g) for g in plain_grams(text or "")]
        z = np.array([np.log(sum(d == x for _, d in texts) / len(texts)) + (scale * np.mean([log[x](f) for f in grams]) if grams else 0) for x in names])
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    half, whole = logs(texts[::2]), logs(texts)
    scale = max((5.0, 10.0, 20.0, 40.0, 80.0), key=lambda s: sum(np.log(posterior(s, half, t)[names.index(d)] + 1e-12) for t, d in texts[1::2]))
    for r in mixing.memberships(docs.limit(30), mixing.fit(texts)).collect():
        assert np.allclose(r.soft.p, posterior(scale, whole, r.text), atol=2e-5) and r.soft.tokens == len((r.text or "").encode().split())


def test_toxicity(spark, small):
    base = small.replace("sf0.001", "sf0.01")
    toxic = {r.doc_id: r.toxic for r in table(spark, base, "labels").collect()}
    found = [r for r in queries.op1_compression_toxicity(spark, base).collect()]
    held = [(toxic[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in toxic]
    assert np.mean([p for y, p in held if y]) > 0.5 and np.mean([p for y, p in held if not y]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_toxicity_equals_plain_compression(spark, small):
    """Scores from their definition, by other calls of the library, under two dictionaries that its trainer made."""
    base = small.replace("sf0.001", "sf0.01")
    docs = table(spark, base, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_texts(docs, table(spark, base, "labels")))
    magic = b"\x37\xa4\x30\xec"  # a trained dictionary begins with it
    assert model.ordinary[:4] == magic and model.toxic[:4] == magic

    def length(window, dictionary):
        with_dict = zstandard.ZstdCompressionDict(dictionary)
        how = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(dict_data=with_dict, compression_params=how).compress(window))

    texts = {r.doc_id: r.text for r in docs.limit(25).collect()}
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for i, text in texts.items():
        data = (text or "").lower().encode()
        starts = range(0, max(1, len(data) - 32), 32)
        gains = sorted((length(w, model.ordinary) - length(w, model.ordinary + model.toxic) for w in (data[a : a + 64] for a in starts)), reverse=True)
        x = (min(gains[0], 16), min(sum(gains[:3]), 32), sum(g - 1 for g in gains if g > 1) / len(gains) ** 0.5)
        z = sum(w * f for w, f in zip(model.weights, x)) + model.weights[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_mixing_meets_targets(spark, small):
    docs = table(spark, small, "documents")
    rows = mixing.mix(docs, "lang", {"en": 1.0, "de": 1.0}).collect()
    p, tokens, rate = (np.array([x(r.mix) for r in rows], float) for x in (lambda m: m.p, lambda m: m.tokens, lambda m: m.rate))
    got = (p * (tokens * rate)[:, None]).sum(axis=0)
    names = sorted({r.lang for r in rows})
    goal = np.array([0.5 if n in ("en", "de") else 0.0 for n in names]) * tokens.sum()
    assert np.abs(got - goal).max() < 1e-3 * tokens.sum() and (rate >= 0).all()
    whole = mixing.rates(docs).collect()
    assert min(r.rate for r in whole) >= 1 - 1e-6 and min(r.copies for r in whole) >= 1
    again = mixing.repeat_rows(mixing.mix(docs, "lang"))
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in whole)


def test_mixing_equals_plain_descent(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 40).round(6)
    tokens = rng.integers(1, 500, 40)
    soft = spark.createDataFrame([(i, (int(t), x.tolist())) for i, (t, x) in enumerate(zip(tokens, p))], "id long, soft struct<tokens: long, p: array<double>>")
    rated, goal, _ = mixing.fit_rates(soft, 3, [5, 3, 2])
    start = (p * tokens[:, None]).sum(axis=0)
    wanted = np.array([5, 3, 2]) / 10 * start.sum()
    r = np.ones(40)
    for _ in range(mixing.ROUNDS):
        r = np.maximum(0, r - p @ (((p * (tokens * r)[:, None]).sum(axis=0) - wanted) / start))
    got = np.array([x.soft.rate for x in rated.orderBy("id").collect()])
    assert np.allclose(goal, wanted, rtol=1e-4) and np.allclose(got, r, atol=1e-3)


OPERATORS = {
    "toxicity": lambda d, l: toxicity.predictions(d, l),
    "language": lambda d, l: language.predictions(d),
    "mixing": lambda d, l: mixing.rates(d),
    "mix": lambda d, l: mixing.repeat_rows(mixing.mix(d, "lang", out=free_name(d, "mix")), free_name(d, "mix")),
    "quality": lambda d, l: quality.verdicts(d, l),
    "keep good": lambda d, l: quality.keep_good(d, quality.log_ratios(d, l)),
    "planes": lambda d, l: plane_files.digest(d, WORD_BPE),
    "simhash": lambda d, l: simhash.fingerprint_table(d),
    "keep first": lambda d, l: simhash.keep_first(d),
    "bpe": lambda d, l: byte_bpe.encode_and_decode(d, BYTE_BPE, public_tokenizers.PATTERN),
    "repeats": lambda d, l: suffix_dedup.remove_repeats(d),
}
SOME = {"keep good", "keep first", "mix"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_tables(spark, awkward, empty, labels, name):
    run = OPERATORS[name]
    clashing = awkward
    for c in ("score", "ids", "decoded", "repeats", "part", "quality", "words", "mix", "soft", "fp", "component", "row", "verdict", "mark", "copy", "held_out", "id", "language"):
        clashing = clashing.withColumn(c, F.lit("x"))
    for docs in (awkward, clashing):
        n = run(docs, labels).count()
        assert n <= awkward.count() if name in SOME - {"mix"} else n >= awkward.count()
    assert run(empty, labels.limit(0)).count() == 0
    assert run(empty, labels).count() == 0
    if name not in SOME:
        assert run(awkward, labels.limit(0)).count() == awkward.count()
