"""Whitening, the filter audit and piece encoding against brute force."""

import collections
import hashlib
import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from specledger.llm import copies, filter_audit, piecewise, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 11 ---
def grid(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute_whitening(rows, components, by_copies=False):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), from numpy over all rows of one length."""
    good = [(i, grid(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    times = collections.Counter(tuple(x) for _, x in good)
    fit = np.array([x for x, k in times.items() for _ in range(k if by_copies else 1)])
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = collections.Counter()
    for i, x in good:
        for k in range(min(components, len(x))):
            axis, value = axes[:, -1 - k], values[-1 - k]
            deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
            out[i, k + 1, n, deviation, round(abs((x - sums / n) @ axis / math.sqrt(value)), 6), round(value / values.sum(), 9)] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(31)
    base = [[rng.gauss(0, 1 + 0.3 * k) for k in range(6)] for _ in range(80)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[3]) for i in range(60)] + [(5, base[5]), (None, base[6])]
    return rows + [(300, None), (301, [None] + base[0][1:]), (302, [math.nan] + base[0][1:]), (303, [math.inf] * 6)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, vectors, weights, monkeypatch):
    monkeypatch.setattr(copies, "HOT", 3)  # the vector with 61 copies is joined by broadcast, others by shuffle
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("packed", F.lit(1)).withColumn("dim", F.lit(2))
    got = whitening.whiten(frame, 4, weights).collect()
    assert collections.Counter((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 6), round(r.explained, 9)) for r in got) == brute_whitening(
        vectors, 4, weights == "count")
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    signs = {}
    for r in got:  # one axis for all rows: the products of two rows have the same sign as those of their projections
        signs.setdefault(r.component, {})[r.vec_id] = r.whitened
    assert all(abs(np.mean([v for i, v in s.items() if i is not None and i < 80])) < 0.2 for s in signs.values()) or weights == "count"


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    # One vector alone has no variance; lengths are fitted apart; a huge entry is clipped and its deviation fits no long.
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [-1.0]), (5, [0.25]), (6, [1e300, 0.0, 1.0]), (7, [0.0, 1.0, 3.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), *((i, k) for i in (6, 7) for k in (1, 2, 3))}
    assert got[1, 1].n == 1 and got[1, 1].deviation == 0 and got[1, 1].whitened is None and got[1, 1].explained is None
    assert got[3, 1].n == 3 and got[3, 1].explained == 1.0 and got[3, 1].identity_error < 1e-12
    assert got[6, 1].deviation is None and got[6, 1].n == 2 and got[6, 2].whitened is None
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, schema), weights="rank")


def test_packing_of_vectors():
    rng = random.Random(2)
    rows = [np.array([rng.randrange(-10 ** rng.randrange(1, 16), 10 ** rng.randrange(1, 16)) for _ in range(k)]) for k in (1, 3, 3, 7) for _ in range(20)]
    packed = [whitening.pack(r[None, :])[0] for r in rows]
    back = [None] * len(rows)
    for at, x in whitening.unpack(packed):
        for i, v in zip(at, x):
            back[i] = v
    assert all((a == b).all() for a, b in zip(rows, back)) and len(set(packed)) == len({tuple(r) for r in rows})


# --- 12 ---
def brute_failures(rows, labels):
    said = collections.defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            said[i] = [said[i][0] or quality == 1, said[i][1] or toxic == 1]
    out = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = text.encode().split()
        mask = (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        mask += 8 * any(c in "#$%&*|" for c in text)
        mask += 16 * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows))
        out.append((lang or "", mask, *(said[i] if i is not None else (False, False))))
    return out


def brute_audit(failures, filters="ABCDE"):
    out = set()
    orders = ["".join(p) for p in itertools.permutations(filters)]
    for part in {f[0] for f in failures}:
        docs = [f for f in failures if f[0] == part]
        rows, total = [], collections.Counter()
        for order in orders:
            left = docs
            for step, name in enumerate(order, 1):
                bit = 1 << filters.index(name)
                gone, left = [d for d in left if d[1] & bit], [d for d in left if not d[1] & bit]
                total[name] += len(gone)
                rows.append((order, step, len(left), len(gone), sum(d[1] & bit > 0 for d in docs) - len(gone), sum(d[1] == bit for d in docs),
                             sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, *r, total[r[0][r[1] - 1]]) for r in rows}
    return out


@pytest.mark.parametrize("n", range(6))
def test_plain_changes_visit_every_order(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT", 4)
    rng = random.Random(17)

    def text():
        words = [rng.choice("abcdefgh") + rng.choice("ijklmnop") + str(rng.randrange(rng.choice((3, 400)))) for _ in range(rng.choice((5, 150, 260)))]
        return " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(("", "", " #", "\x0b|", " É"))

    texts = [text() for _ in range(60)] + [None, "", " \t", "É" * 400, "A b " * 5000]
    rows = [(i, rng.choice(texts[:65] if i > 100 else texts), rng.choice(("en", "de", None)), "s", 1) for i in range(150)]
    rows += [(200 + i, texts[0], "en", "s", 1) for i in range(90)] + [rows[3], (3, texts[7], "fr", "s", 1), (None, texts[0], "en", "s", 1), (None, None, None, None, None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 220, 2)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("m")).withColumn("digest", F.lit(1)).withColumn("quality", F.lit(1))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    failures = filter_audit.document_failures(frame, said)
    want = brute_failures(rows, labels)
    found = collections.Counter()
    for r in failures.collect():
        found[r.part, r["mask"], r.good, r.toxic] += r.n
    assert found == collections.Counter(want)
    got = filter_audit.audit_filters(failures).collect()
    assert {tuple(r) for r in got} == brute_audit(want) and len(got) == 600 * len({f[0] for f in want})
    none = filter_audit.audit_filters(filter_audit.document_failures(frame.limit(0), said))
    assert none.count() == 0 and filter_audit.document_failures(frame, said.limit(0)).filter("good or toxic").count() == 0


@pytest.mark.parametrize("filters", ["A", "XY", "PQRS"])
def test_audit_of_any_filters(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice("pq"), rng.randrange(1 << len(filters)), rng.random() < 0.5, rng.random() < 0.2) for _ in range(200)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "part string, mask int, good boolean, toxic boolean, n long")
    assert {tuple(r) for r in filter_audit.audit_filters(frame, filters).collect()} == brute_audit(rows, filters)


# --- 13 ---
@pytest.fixture(scope="module")
def model():
    return piecewise.piece_model(piecewise.default_model())


def odd_texts(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


PARTS = [" ", "  ", "▁", "a", "the ", "\n", "\t", "é", "🙂", "中文", "́", "<s>", "<0x0A>", "<unk>", "　", "\x00", "ab" * 20, "Straße"]


def spans(processor, text):
    found = processor.encode(text, return_type="proto").pieces
    return [p.id for p in found], [p.begin for p in found], [p.end for p in found]


def test_pieces_and_spans_are_the_librarys(model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piecewise.default_model())
    for text in [*odd_texts(1, 600, PARTS), "a" * 4000, " " * 100, "▁" * 9]:
        assert [x.tolist() for x in model.encode(text)] == list(spans(library, text)) or not text


def double_array(entries):
    """A compiled character map, built by placing the children of each node at the first base that is free."""
    strings, values = b"", {}
    for key, new in sorted(entries.items()):
        values[key.encode()] = len(strings)
        strings += new.encode() + b"\0"
    units, taken, bases = {0: 0}, {0}, set()
    left = [(0, b"", sorted(values))]
    while left:
        node, prefix, keys = left.pop()
        children = sorted({k[len(prefix)] for k in keys if len(k) > len(prefix)})
        ends = prefix in values
        base = next(b for b in itertools.count(1) if b not in bases | taken and all(b ^ c not in taken for c in children))
        bases.add(base)
        units[node] |= (node ^ base) << 10 | (256 if ends else 0)
        if ends:
            units[base] = 1 << 31 | values[prefix]
        taken |= {base} | {base ^ c for c in children}
        for c in children:
            units[base ^ c] = c
            left.append((base ^ c, prefix + bytes([c]), [k for k in keys if k.startswith(prefix + bytes([c]))]))
    size = max(units) + 1 | 255
    trie = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size + 1))
    return struct.pack("<I", len(trie)) + trie + strings


MAP = {"ß": "ss", "ﬁ": "fi", "　": " ", "\t": " ", "A": "a", "AB": "x", "ABC": "yyyé", "é": "e", "́": "", "中文": "z ", "🙂": "🙂🙂"}


def with_normaliser(data, **flags):
    """The model with another normaliser."""
    numbers = {"blob": 2, "dummy": 3, "trim": 4, "escape": 5}
    own = piecewise.field(1, b"own")
    for name, value in flags.items():
        own += piecewise.field(numbers[name], value) if isinstance(value, bytes) else bytes([numbers[name] << 3, int(value)])
    return b"".join(piecewise.field(n, v) for n, v in piecewise.message(data) if n != 3 and isinstance(v, bytes)) + piecewise.field(3, own)


def test_character_map_is_read_back():
    assert piecewise.read_character_map(double_array(MAP)) == MAP and piecewise.read_character_map(b"") == {}


@pytest.mark.parametrize("dummy,trim,escape", list(itertools.product((True, False), repeat=3)))
def test_normalisation_by_longest_prefix(model, dummy, trim, escape):
    import sentencepiece

    with open(piecewise.default_model(), "rb") as file:
        data = with_normaliser(file.read(), blob=double_array(MAP), dummy=dummy, trim=trim, escape=escape)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), piecewise.PieceModel(data)
    parts = [*MAP, " ", "  ", "b", "B", "C", "the", "\n", "▁", "ab"]
    for text in odd_texts(7, 800, parts):
        ids, begins, ends = own.encode(text)
        want = spans(library, text)
        assert ids.tolist() == want[0], text
        assert (begins.tolist(), ends.tolist()) == want[1:], text


def test_other_models_are_refused():
    with open(piecewise.default_model(), "rb") as file:
        data = file.read()
    with pytest.raises(ValueError):
        piecewise.PieceModel(b"".join(piecewise.field(n, v) for n, v in piecewise.message(data) if n != 2))


def test_encode_documents(spark, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piecewise.default_model())
    texts = [*odd_texts(3, 40, PARTS), None, "", "word " * 30000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "null id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piecewise.encode_documents(frame).collect())
    assert got == collections.Counter((i, tuple(ids), library.decode(ids)) for i, t in rows for ids in [library.encode(t or "")])
    assert piecewise.encode_documents(frame.limit(0)).count() == 0
    for r in piecewise.encode_documents(frame.filter("doc_id = 42")).collect():
        data = texts[42].encode()
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data


def test_digests_of_pieces(spark, tmp_path):
    import sentencepiece

    from specledger.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=piecewise.default_model())
    texts = [*odd_texts(4, 30, PARTS), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {tuple(r) for r in QUERIES["op13_pieces"](spark, str(tmp_path)).collect()}
    assert got == {(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in enumerate(texts) for ids in [library.encode(t or "")]}
