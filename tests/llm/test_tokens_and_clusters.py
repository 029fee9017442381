"""SentencePiece words, ball trees and token alignment against plain versions."""

import bisect
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lodegraph.llm import centroid_clusters, sentence_pieces, token_alignment
from lodegraph.llm.common import frequent
from tests.llm import fixture as fx

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Names that clash with what the operators write or use, and names that Spark would take for fields of a struct.
CLASH = ["x.y", "a b", "ids", "decoded", "row", "id", "v", "cluster", "distance", "centroid", "n_a", "n_groups", "links", "pair", "n", "groups", "kind", "word", "c0"]
ODD = ["", " ", "  ", " a ", "▁", "▁▁a ▁", "\n", "a\n b", "<0x0A>", "<s>x</s>", "<|endoftext|> y", "日本語 テスト", "😀 \x00 ​", "a​ b", "a\x85 b", "x" * 3000, " " * 70 + "a", "a  ", "don't 's"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("  ab\né日😀\t<0xs>'​1▁") for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    return [None, *ODD, *made, *[t for _, t, *_ in fx.documents()]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_are_the_librarys(docs, texts, library):
    rows = sentence_pieces.encode(docs, MODEL, back_col="back").collect()
    assert len(rows) == len(texts) and {"x.y", "a b"} <= set(rows[0].__fields__)
    for r in rows:
        want = library.encode(texts[r.doc_id] or "")
        assert (r.ids, r.back) == (want, library.decode(want))


def test_the_table_changes_no_result(spark, docs, library):
    whole, small = sentence_pieces.word_table(docs, MODEL), sentence_pieces.word_table(docs, MODEL, held=40)
    assert 0 < small.count() <= 40 < whole.count()
    for r in whole.collect():
        assert np.frombuffer(r.ids, np.int32).tolist() == library.encode(r.word[1:]) or r.word == "▁"
    a, b = (sorted((r.doc_id, r.ids) for r in sentence_pieces.encode(docs, MODEL, table=t, drop_text=True).collect()) for t in (small, spark.createDataFrame([], whole.schema)))
    assert a == b


def test_any_ids_decode_as_the_library_does(spark, library):
    rng = random.Random(4)
    kinds = [lambda: rng.randrange(32000), lambda: rng.randrange(4), lambda: rng.randrange(3, 259), lambda: library.piece_to_id("▁")]
    lists = [[], *[[rng.choice(kinds)() for _ in range(rng.randrange(1, 8))] for _ in range(3000)]]
    rows = sentence_pieces.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "k int, ids array<int>").withColumn("x.y", F.lit(1)), MODEL).collect()
    assert all(r.text == (library.decode(lists[r.k]) if r.k >= 0 else "") for r in rows)


def test_ids_become_lists_without_an_object_of_arrow_each():
    import pyarrow as pa

    plain = pa.array([[1, 2, 3], [], [4], [5, 6]], pa.list_(pa.int32()))
    held = [plain, plain.slice(1, 2), plain.slice(2), plain[:0], pa.array([[7], None, [], [8, 9]], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))]
    for ids in held:
        assert sentence_pieces._lists(ids) == ids.to_pylist()
    many = pa.ListArray.from_arrays(pa.array([0, 300_000], pa.int32()), pa.array(range(300_000), pa.int32()))
    began = time.process_time()
    many.to_pylist()
    slow, began = time.process_time() - began, time.process_time()
    sentence_pieces._lists(many)
    assert time.process_time() - began < slow / 2


def test_pieces_of_nothing(docs):
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0
    assert token_alignment.align(docs.limit(0), BYTES, MODEL).count() == 0


def test_frequent_rows_fit_the_bounds(spark):
    counted = spark.createDataFrame([(n,) for n in (1, 1, 2, 3, 4, 9)], "n long")
    assert [frequent(counted, "n", k) for k in (0, 1, 3, 4, 6)] == [(2**63 - 1, False), (8, False), (4, False), (2, False), (1, True)]
    assert frequent(counted.limit(0), "n", 5) == (2**63 - 1, True)


def clusters(vectors, k, rounds, seed=3):
    """By comparing all vectors with all centroids."""
    ranked = sorted(vectors, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    points, centroids = [v for _, v in vectors], [list(v) for _, v in ranked[:k]]
    for step in range(rounds + 1):
        best = [min((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), j) for j, c in enumerate(centroids)) for p in points]
        if step < rounds:
            for j in range(len(centroids)):
                own = [p for p, b in zip(points, best, strict=True) if b[1] == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return best, centroids


def vectors_of(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    if kind == "ties":
        return [(i, [float(rng.randrange(-1, 2)) / 512 for _ in range(4)]) for i in range(300)]
    if kind == "large":
        return [(i, [rng.uniform(-1, 1) * 131_000 for _ in range(4)]) for i in range(120)]
    if kind == "few":
        return [(1, [0.5] * 4), (1, [0.5] * 4), (None, [0.25] * 4)]
    middles = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [rng.gauss(x, 0.03) for x in rng.choice(middles)]) for i in range(900)]
    return rows + rows[:200] + [(2000, [0.1] * 4)] * 300


@pytest.mark.parametrize("kind", ["groups", "ties", "large", "few"])
def test_clusters_are_exact(spark, kind):
    rows = vectors_of(kind)
    bad = [(-1, None), (-2, [0.1] * 3), (-3, [0.1, None, 0.1, 0.1]), (-4, [0.1, float("nan"), 0.1, 0.1]), (-5, [float("inf"), 0.1, 0.1, 0.1]), (-6, [])]
    table = spark.createDataFrame([(str(0), i, v) for i, v in rows + bad], "label string, `vec id` long, `e.v` array<double>").repartition(3)
    got = centroid_clusters.cluster(table, k=5, rounds=4, dims=4, id_col="vec id", vec_col="e.v").collect()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    best, centroids = clusters(whole, 5, 4)
    sums = defaultdict(int)
    for d, j in best:
        sums[j] += d
    want = Counter((i, j, d, sums[j], sum(sums.values()), tuple(centroids[j])) for (i, _), (d, j) in zip(whole, best, strict=True))
    assert Counter((r["vec id"], r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == want


def test_balls_take_whole_groups(spark):
    points = np.array([[int(1024 * x) for x in v] for _, v in vectors_of("groups")], np.int64)
    order, balls = centroid_clusters.grown(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    points = points[order]
    for a, b, left, radius, centre, total in zip(*balls[:6], strict=True):
        assert (np.sqrt(((points[a:b] - centre) ** 2).sum(1)) <= radius).all() and (points[a:b].sum(0) == total).all()
        assert left == 0 or (balls.first[left], balls.last[left], balls.last[left + 1]) == (a, balls.first[left + 1], b)
    found = list(centroid_clusters.assigned(centroid_clusters.Balls.unpack(balls.pack()), points, points[::150]))
    assert sum((balls.last[w] - balls.first[w]).sum() + len(p) for _, w, p in found) == len(points)
    assert sum(len(p) for *_, p in found) < len(points) / 2  # the others need no distance of their own


def test_clusters_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroid_clusters.cluster(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert centroid_clusters.cluster(empty).count() == 0
    with pytest.raises(Exception, match="larger than"):
        centroid_clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).count()


def aligned(text, a, b):
    """Tokens, groups, overlaps, groups as a string and links of one text, from whole encodings."""
    if not text:
        return (0, 0, 0, 0), "", []
    back = token_alignment._unbyte()
    want = (" " + text).encode()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
    if b"".join(xs) != want or b"".join(ys) != want:
        return (0, 0, 0, 0), "", []
    ex, ey = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted({*ex} & {*ey}):
        p, q = bisect.bisect_right(ex, end), bisect.bisect_right(ey, end)
        groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
        links.append((x[p - 1], y[q - 1]))
        i, j = p, q
    overlaps = sum(bisect.bisect_left([0, *ey[:-1]], e) - bisect.bisect_right(ey, s) for s, e in zip([0, *ex[:-1]], ex, strict=True))
    return (len(x), len(y), len(groups), overlaps), ";".join(groups), links


@pytest.fixture(scope="module")
def alignments(texts, library):
    a = tokenizers.Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return [aligned(t, a, library) for t in texts]


@pytest.mark.parametrize("held", [token_alignment.HELD, 5, 0])
def test_alignment(docs, alignments, held):
    counts = Counter(link for _, _, links in alignments for link in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = token_alignment.align(docs, BYTES, MODEL, held=held).collect()
    assert len(rows) == len(alignments) and max(r.count_sum for r in rows) > 0
    for r in rows:
        numbers, groups, links = alignments[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_overlaps) == numbers and r.n_links == len(links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r.count_sum == sum(counts[x] for x in links) and r.n_best == sum(counts[x] == most[x[1]] for x in links)


def test_a_lot_of_words_is_joined_once(alignments, texts):
    """Overlaps follow from tokens and groups; no joins of their own for them."""

    class Asked:
        def __init__(self, duck):
            self.duck, self.n = duck, 0

        def register(self, *args):
            return self.duck.register(*args)

        def execute(self, *args):
            self.n += 1
            return self.duck.execute(*args)

    own = token_alignment.Aligner(BYTES, MODEL)
    own.duck = Asked(own.duck)
    assert [tuple(c.tolist()) for c, *_ in own.texts(texts)] == [numbers for numbers, *_ in alignments]
    assert own.duck.n == 1


def test_groups_and_small_tables_of_words(docs, alignments, monkeypatch):
    got = {r.doc_id: r["groups"] for r in token_alignment.groups(docs, BYTES, MODEL).collect()}
    assert got == {i: g for i, (_, g, _) in enumerate(alignments)}
    monkeypatch.setattr(token_alignment, "KEPT", 20)
    monkeypatch.setattr(token_alignment, "LOT", 50)
    own = token_alignment.Aligner(BYTES, MODEL)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    found = [g for k in range(0, len(texts), 7) for _, g, *_ in own.texts(texts[k : k + 7])]
    assert found == [g for _, g, _ in alignments]


@pytest.mark.parametrize(("retries", "earlier"), [(1, 32)])
def test_template_families_by_all_pairs(spark, monkeypatch, retries, earlier):
    """Texts of one template that differ in slots of a few words, most of them just under the similarity; and a group whose copies are linked through others only."""
    from lodegraph.llm import near_dedup

    rng = random.Random(21)
    base = [f"b{i}" for i in range(60)]
    family = []
    for _ in range(160):
        w = list(base)
        for slot in range(3, 60, 8):
            w[slot] = f"s{slot}v{rng.randrange(4)}"
        family.append(" ".join(w))
    chain = [" ".join(f"c{i}" for i in range(k, k + 40)) for k in range(0, 60, 3)]
    rows = list(enumerate(family + chain))
    monkeypatch.setattr(near_dedup, "RETRIES", retries)
    monkeypatch.setattr(near_dedup, "EARLIER", earlier)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.components(rows, 2, 80)
