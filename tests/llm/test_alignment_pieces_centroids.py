"""Cross-tokenizer alignment, SentencePiece spans and centroid clustering against the libraries and brute force, and on
awkward tables: nulls, empty and very long texts, ties, repeated rows, no rows, columns with clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from tokenizers import Tokenizer

from coordwave.llm import alignment, centroids, queries, sentence_piece
from coordwave.llm.common import table

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = [*"ab \n\t▁é了𝄞\x00\x1c�'12", "  ", "   the", "</s>", "<s>", "<0x0A>", "<|endoftext|>", "ing ", "zwölf ", "▁the", "\r\n", "'ll", "ﬁ", "㍿", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*texts, "ab" * 3000 + "é" * 2000, "word\n" * 3000, "x " * 20_000, " lead", "trail ", "a", ""]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def mapped_model(tmp_path_factory):
    """The same pieces with a compiled character map, and with runs of spaces made one."""
    rules = SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    own = [x for n, x in sentence_piece._fields(rules) if n == 3][0]
    with open(PIECES, "rb") as f:
        fields = [(n, x) for n, x in sentence_piece._fields(f.read()) if n in (1, 2)]
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(b"".join(sentence_piece._field(n, x) for n, x in fields) + sentence_piece._field(3, own))
    return str(path)


def check_pieces(path, texts):
    library, own = SentencePieceProcessor(model_file=path), sentence_piece.Codec(path)
    for text, (ids, starts, stops) in zip(texts, own.encode(texts), strict=True):
        found = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in found] + [2], repr(text)
        for p, a, b in zip(found, starts.tolist(), stops.tolist()):
            if not library.is_byte(p.id):
                assert (a, b) == (p.begin, p.end), (text, p.piece)
        assert starts[-1] == stops[-1] == len(text.encode())
        assert own.decode(ids) == library.decode(ids.tolist())


def test_pieces_and_spans_equal_the_library():
    check_pieces(PIECES, odd_texts(3000))


def test_pieces_and_spans_with_a_character_map(mapped_model):
    model = sentence_piece.Model(mapped_model)
    assert model.map.units and model.fewer_spaces and not model.plain
    check_pieces(mapped_model, [t for t in odd_texts(1500, 6) if t.strip() or not t] + ["ＡＢ ㍿ﬁ", "  a　　b  ", " x"])


def test_byte_pieces_stand_for_their_bytes():
    ids, starts, stops = sentence_piece.codec(PIECES).encode(["a𝄞b"])[0]
    spans = list(zip(starts.tolist(), stops.tolist()))
    assert spans[0] == (0, 1) and spans[-1] == (6, 6) and (1, 2) in spans and (4, 5) in spans


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(sentence_piece, "MOST_CHUNKS", 50)
    own = sentence_piece.Codec(PIECES)
    texts = odd_texts(300)
    plain = [sentence_piece.codec(PIECES).encode([t])[0][0].tolist() for t in texts]
    assert [r[0].tolist() for at in range(0, len(texts), 40) for r in own.encode(texts[at : at + 40])] == plain and len(own.known) <= 50


def text_rows():
    texts = [*odd_texts(200), None, "plain text, twice", "plain text, twice"]
    return [(i, t, "mine") for i, t in enumerate(texts)] + [(3, "again", None), (None, None, None), (None, "no id", "x")]


def test_pieces_of_a_table(spark, library):
    docs = spark.createDataFrame(text_rows(), "doc_id long, text string, pieces string")
    made = sentence_piece.encode_and_decode(docs, PIECES)
    assert made.columns == ["doc_id", "text", "pieces", "_pieces", "decoded"]
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes) for r in sentence_piece.digest(docs, PIECES).collect())
    want = []
    for i, t, _ in text_rows():
        ids = library.encode(t or "") + [2]
        want.append((repr(i), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    assert got == sorted(want)
    assert sentence_piece.digest(docs.limit(0), PIECES).count() == 0


def brute_alignment(texts):
    """Tokens, groups and links of each text by walking both sequences; no chunks, labels or caches."""
    a_file, b_file = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    a_file.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = dict(zip([*map(chr, shown), *(chr(256 + k) for k in range(256 - len(shown)))], [*shown, *(b for b in range(256) if b not in shown)]))
    out = []
    for t in texts:
        a = a_file.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_file.encode(t) if t else []
        a_bytes = [bytes(alphabet[c] for c in a_file.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if t and b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            x, y, left, right, at_a, at_b = [], [], list(zip(a, a_bytes)), list(zip(b, b_bytes)), 0, 0
            while left or right:
                if at_a <= at_b and left:
                    x.append(left[0][0])
                    at_a += len(left.pop(0)[1])
                else:
                    y.append(right[0][0])
                    at_b += len(right.pop(0)[1])
                if at_a == at_b:
                    groups.append((x, y))
                    x, y = [], []
        out.append(groups)
    return out


def brute_digest(rows):
    found = brute_alignment([t for _, t, *_ in rows])
    links = [Counter((i, j) for x, y in groups for i in x for j in y) for groups in found]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc, *_), groups, own in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(k for p, k in own.items() if count[p] == best[p[0]])
        sums = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), n_best, sum(k * count[p] for p, k in own.items()))
        out.append((repr(doc), *sums, sha(text) if groups else ""))
    return sorted(out)


@pytest.mark.parametrize("part_pairs", [alignment.PART_PAIRS, 300])
def test_alignment_equals_brute_force(spark, part_pairs):
    rows = [r for r in text_rows() if len(r[1] or "") < 9000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    got = [(repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.digest(docs, BYTE_BPE, PIECES, part_pairs).collect()]
    assert sorted(got) == brute_digest(rows)
    assert alignment.digest(docs.limit(0), BYTE_BPE, PIECES).count() == 0


def test_alignment_of_the_documents(spark, small):
    docs = table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in queries.op11_label_string_alignment(spark, small).collect()]
    assert sorted(got) == brute_digest(rows)


def test_alignment_keeps_columns_and_begins_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two", "x")], "doc_id long, text string, alignment string")
    assert alignment.align(docs, BYTE_BPE, PIECES).columns == ["doc_id", "text", "alignment", "_alignment"]
    monkeypatch.setattr(alignment, "MOST_CHUNKS", 20)
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 2)
    own, texts = alignment.Aligner(BYTE_BPE, PIECES), odd_texts(120)[:120]
    for t, groups in zip(texts, brute_alignment(texts)):
        facts, listed, pairs, times, _ = own.align([t])
        links = Counter(i * own.n_b + j for x, y in groups for i in x for j in y)
        assert facts[0].tolist()[2:] == [len(groups), sum(links.values())] and dict(zip(pairs.tolist(), times.tolist())) == links


def vector_rows(dims=64):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=dims).round(2).tolist()) for i in range(150)]
    rows += [(i, rows[i][1]) for i in range(5)] + [(900, rows[0][1]), (901, rows[0][1])]  # repeats and ties
    rows += [(None, rows[7][1]), (910, None), (911, []), (912, [1.0] * (dims - 1)), (913, [None] + [0.0] * (dims - 1)), (914, [float("nan")] * dims), (915, [float("inf")] * dims)]
    return rows


def brute_clusters(rows, k, rounds, dims=64):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    means = [v for _, _, v in sorted((sha(f"1:{i}"), i, v) for i, v in kept if i is not None)][:k]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        own = [min(range(len(means)), key=lambda c: (away(v, means[c]), c)) for _, v in kept]
        if turn < rounds:
            groups = [[v for (_, v), o in zip(kept, own) if o == c] for c in range(len(means))]
            means = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, means)]
    d = [away(v, means[o]) for (_, v), o in zip(kept, own)]
    by = Counter()
    for o, x in zip(own, d):
        by[o] += x
    most = (1 << 63) - 1
    return sorted((repr(i), o, min(most, x), min(most, by[o]), min(most, sum(d)), sha(",".join(map(str, means[o])))) for (i, _), o, x in zip(kept, own, d))


def clusters_of(frame):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.digest(frame).collect())


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e30])
def test_clusters_equal_brute_force(spark, scale):
    rows = [(i, v if v is None else [x if x is None else x * scale for x in v]) for i, v in vector_rows()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert clusters_of(frame) == brute_clusters(rows, 16, 3)


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>, cluster string"
    rows = [(1, [0.5] * 64, "x"), (2, [0.5] * 64, "y"), (2, [0.25] * 64, None)]
    assert clusters_of(spark.createDataFrame(rows, kind)) == brute_clusters([r[:2] for r in rows], 16, 3)
    assert clusters_of(spark.createDataFrame([(1, None, "x")], kind)) == [] == clusters_of(spark.createDataFrame([], kind))


def test_screening_is_rigorous_and_screens():
    """Distances that differ by one in ten million, and data where one product decides nearly all rows."""
    rng = np.random.default_rng(9)
    base = rng.integers(-4000, 4000, 64)
    means = [(base + rng.integers(-1, 2, 64)).tolist() for _ in range(40)]
    values = (base + rng.integers(-2, 3, (500, 64))).astype(np.float64)
    found, distance, _, again = centroids.nearest(values, means)
    exact = ((values.astype(np.int64)[:, None] - np.array(means)) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and again > 500
    spread = [rng.integers(-4000, 4000, 64).tolist() for _ in range(16)]
    near = (np.array(spread)[rng.integers(0, 16, 2000)] + rng.integers(-50, 50, (2000, 64))).astype(np.float64)
    assert centroids.nearest(near, spread)[3] < 40


def test_clusters_equal_sql(spark, small):
    got = queries.op13_screened_centroids(spark, small).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_screened_centroids"]).fetchdf()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_results_don_t_depend_on_partitions(spark):
    frame = spark.createDataFrame([r for r in vector_rows() if r[0] is not None], "vec_id long, embedding array<float>")
    assert clusters_of(frame.repartition(1)) == clusters_of(frame.repartition(7).withColumn("id", F.lit(1)))
