"""The training-data operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from specledger.llm import (components, decontaminate, golay, licences, packing, quality, sharding, simhash, suffix, urls, warc,
                            wordpiece)

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(R.randrange(2, 9))) for _ in range(3000)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, rng=R):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def shout(text):
    """Capitals for a-z only: other letters may change their length."""
    return "".join(c.upper() if c.isascii() else c for c in text)


def edited(text, n, rng=R):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = rng.choice(VOCAB)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [prose(R.randrange(60, 300)) for _ in range(60)]
    passage = prose(90)
    texts = [*base, base[0], base[0], shout(base[1]), edited(base[2], 1), edited(base[3], 1), prose(80) + " " + passage + " " + prose(70),
             passage + "\n" + prose(100), None, "", " \n\t ", "one two", "€" * 300, "ab" * 900, "x y " * 2000, prose(12000)]
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 1) for i, t in enumerate(texts)]
    return [*out, out[5], (7, "another text under a used id", "en", "s0", 1), (None, base[4], "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns with names that the operators use inside.
    return spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("key", F.lit("k")).withColumn("rid", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---
def test_warc_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    pages = [(5, "http://a/", tricky), (3, "http://b\r\n/", tricky), (9, None, tricky), (9, None, tricky), (1, "u", "short"), (2, "u", "short"),
             (4, "u", None), (None, "u", "é" * 80), (6, "u", "é" * 80)]
    frame = spark.createDataFrame(pages, "record_id long, url string, payload string")
    got = collections.Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(frame).collect())
    want = collections.Counter()
    for i, _, body in pages:
        data = (body or "").encode()
        same = [j for j, _, b in pages if (b or "").encode() == data and j is not None]
        first = min(same, default=None) if len(data) >= 100 and sum((b or "").encode() == data for _, _, b in pages) > 1 else None
        revisit = first is not None and i != first
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    # Archives with copies in, archives with revisits out, payloads intact; a second pass changes nothing.
    one, two, three = (str(tmp_path / n) for n in "abc")
    plain = warc.with_digest(frame.filter("record_id is not null").dropDuplicates(["record_id"])).withColumn("refers_to", F.lit(None).cast("long"))
    warc.write_archives(plain, one)
    warc.deduplicate_archives(spark, one, two)
    warc.deduplicate_archives(spark, two, three)
    for path in (two, three):
        found = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
        assert {i for i, r in found.items() if r.record_type == "revisit"} == {5, 9}
        assert all((found[r.refers_to or i].payload or "") == (body or "") for i, _, body in pages if i is not None for r in [found[i]])
    assert warc.archive_pages(frame.limit(0)).count() == 0


# --- 2 ---
def test_golay_is_perfect_and_neighbours_share_keys():
    words = np.arange(1 << 12, dtype=np.int64) * 2039 % (1 << 23)
    keys = golay.near_indices(words)
    assert set((keys >= 0).sum(1)) <= {1, 6}
    for _ in range(3):
        other = words.copy()
        for _ in range(2):
            other ^= 1 << np.array([R.randrange(23) for _ in words])
        shared = [set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, golay.near_indices(other))]
        assert all(shared)


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_of(pairs, got)
    assert len({(got[n], want[n]) for n in got}) == 3 == len(set(got.values()))
    assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_links(spark, docs, rows):
    got = collections.Counter(tuple(r) for r in simhash.link_fingerprints(docs).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2]
    root = components_of(links, set(fps))
    least = {}
    for r, fp in zip(rows, fps):
        if r[0] is not None:
            least[root[fp]] = min(r[0], least.get(root[fp], r[0]))
    assert got == collections.Counter((r[0], f"{fp:016x}", least.get(root[fp])) for r, fp in zip(rows, fps))


def test_close_fingerprints_with_large_groups(spark):
    centre = R.getrandbits(64)
    values = {centre} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a, 64, 2)} | {R.getrandbits(64) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 2 for a, b in edges)
    want = components_of([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2], signed)
    assert components_of(edges, signed) == want


def test_near_dedup(spark, docs, rows):
    out = simhash.near_dedup(docs)
    assert out.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in out.collect())
    assert ids[None] == 2 and max(n for i, n in ids.items() if i is not None) == 1
    # Copies, other case and one changed word go; so do all but one text without words.
    assert not {60, 61, 62, 63, 64} & set(ids) and set(range(60)) <= set(ids)
    assert len({67, 68, 69} & set(ids)) == 1 and {65, 66, 71, 72, 74} <= set(ids)


def test_near_dedup_recall(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        text = prose(rng.randrange(100, 400), rng)
        texts += [text, edited(text, max(1, len(text.split()) // 60), rng)]
    similar = []
    for k in range(0, len(texts), 2):
        a, b = (set(simhash.shingles(t, 5)) for t in texts[k:k + 2])
        if len(a & b) >= 0.8 * len(a | b):
            similar.append(k + 1)
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(0, 300, 2)) <= kept
    assert sum(k not in kept for k in similar) >= 0.95 * len(similar) > 100


def test_near_dedup_of_crowds(spark):
    """A text comes after many edited copies, which are similar to it but hardly to each other."""
    rng = random.Random(9)
    texts, originals = [], []
    for copies in (120, 60):
        original = prose(400, rng)
        texts += [edited(original, 7, rng) for _ in range(copies)] + [original]
        originals.append(original)
    sets = [set(simhash.shingles(t, 5)) for t in texts]

    def alike(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    root = components_of([(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])], range(len(texts)))
    want = set(root.values())
    assert not all(alike(sets[0], s) for s in sets[:121]) and len(want) == 2
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # The search is probabilistic: as for pairs, a twentieth may be missed.
    assert want <= kept and len(kept - want) <= 0.05 * len(texts)


def test_near_dedup_finds_longer_texts(spark):
    rng = random.Random(12)
    texts = []
    for k in range(300):
        text = prose(rng.randrange(100, 400), rng)
        extra = prose(int(len(text.split()) * (0.05 + 0.0006 * k)), rng)
        line = prose(3, rng) + "\n"
        texts += [line * (k % 3) + text, line * (2 * k % 40) + text + " " + extra if k % 2 else extra + " " + text]
    similar = set()
    for k in range(0, len(texts), 2):
        a, b = (set(simhash.shingles(t, 5)) for t in texts[k:k + 2])
        if len(a & b) >= 0.8 * len(a | b):
            similar.add(k + 1)
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(range(600)) - kept == similar and len(similar) > 200


def test_near_dedup_of_templates(spark):
    """Twins among many pages of one template, whose own parts keep other pages just below the limit."""
    rng = random.Random(13)
    frame = prose(350, rng)
    pages = [frame + " " + prose(50, rng) for _ in range(1000)]
    texts = [*pages, *[" ".join([*p.split()[:-6], rng.choice(VOCAB), *p.split()[-5:]]) for p in pages]]
    a, b, c = (set(simhash.shingles(texts[k], 5)) for k in (0, 1, 1000))
    assert len(a & b) < 0.8 * len(a | b) and len(a & c) >= 0.8 * len(a | c)
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(1000))


def test_near_dedup_inside_crowds(spark):
    """Some of the copies of a lost text are edited at the same places, so that they resemble each other but no other copy."""
    rng = random.Random(14)
    original = prose(400, rng)
    texts = [edited(original, 7, rng) for _ in range(60)]
    for _ in range(10):
        places = rng.sample(range(400), 7)
        texts += [" ".join(rng.choice(VOCAB) if i in places else w for i, w in enumerate(original.split())) for _ in range(2)]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(components_of(links, range(len(texts))).values()) and len(links) >= 10


# --- 3 ---
def test_longest_match():
    rng = random.Random(2)
    for _ in range(60):
        entries = {rng.choice(["", "_"]) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(2, 25))}
        automaton = wordpiece.Automaton(sorted(entries))
        for _ in range(60):
            word = rng.choice(["", "_"]) + "".join(rng.choice("abcd" if rng.random() < 0.05 else "abc") for _ in range(rng.randrange(1, 12)))
            at = pieces = 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
                if end is None:
                    pieces = 0
                    break
                at, pieces = end, pieces + 1
            assert automaton.pieces(word) == pieces


def test_token_counts(spark, docs, rows, empty):
    got = {r.doc_id: r for r in wordpiece.token_counts(docs).collect()}
    assert len(wordpiece.token_counts(docs).collect()) == len(rows) and wordpiece.token_counts(empty).count() == 0
    assert got[67].n_pieces == got[69].n_words == 0 and got[70].n_words == 2 <= got[70].n_pieces


# --- 4 ---
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_urls(spark):
    pages = [(1, "http://A.Example.NET/en/x?q", None), (2, "https://b.net/x#y", '<a href="http://GOOD.org/fr/">'), (3, "http://b.net", ""),
             (4, "mailto:x", ""), (5, None, ""), (6, "http://good.org/fr/1", ""), (7, "http://links.io/a?x=/fr/", '<a href=//b.net/q>'), (7, "x://fine.io/", ""),
             (8, "http://good.org/de/1", '<a href="http://fine.io/">'), (9, "http://xnet/", ""), (10, "http://b.net/1", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("rule", F.lit(0))
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge_urls(frame, RULES).collect()}
    assert got == {
        (1, "a.example.net"): ("/en/x", "example.net/en/", "allow"), (2, "b.net"): ("/x", "net/", "block"), (3, "b.net"): ("", None, "block"),
        (4, ""): ("", None, "allow"), (5, ""): ("", None, "allow"), (6, "good.org"): ("/fr/1", "org/fr/", "allow"),
        # It links to a blocked host, which passes distrust back.
        (7, "links.io"): ("/a", None, "block"), (7, "fine.io"): ("/", None, "allow"), (8, "good.org"): ("/de/1", None, "allow"),
        (9, "xnet"): ("/", None, "allow"), (10, "b.net"): ("/1", "net/", "block")}
    assert urls.judge_urls(frame.limit(0), RULES).count() == 0 and urls.judge_urls(frame, []).filter("rule is not null").count() == 0


# --- 5 ---
def test_fullest_is_best():
    rng = random.Random(4)
    for _ in range(200):
        stock = sorted({rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}.items(), reverse=True)
        room = rng.randrange(0, 50)
        sums = {0}
        for length, n in stock:
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        mix = packing.fullest(room, stock)
        assert sum(k * n for k, n in mix.items()) == max(sums) and all(n <= dict(stock)[k] for k, n in mix.items())


def test_packing(spark, docs, rows, empty):
    tokenizer = packing.token_ids(packing.default_tokenizer()).tokenizer
    got = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024
    room = []  # first fit, longest first
    for n in sorted((r.length for r in got), reverse=True):
        k = next((k for k, free in enumerate(room) if free >= n), None)
        if k is None:
            room.append(1024 - n)
        else:
            room[k] -= n
    assert len(bins) <= len(room)
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("slot_rows", [3, 1000])
def test_packing_places_in_slices(spark, slot_rows):
    pieces = spark.createDataFrame([(i, 0, 0, 1 + i % 7, 0) for i in range(300)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.assign(pieces, 10, slot_rows).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 300 and len(bins) == -(-sum(r.length for r in got) // 10)
    assert all(sorted(b)[k][0] == sum(n for _, n in sorted(b)[:k]) for b in bins.values() for k in range(len(b)))


def test_token_ids_are_the_tokenizers():
    tokens = packing.token_ids(packing.default_tokenizer())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "b'", "'s", "é", ".", "12", "\t", " \n", "x y", " ", "\x1c", "<|endoftext|>", "日本", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert tokens.ids(text) == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- 6 ---
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, docs, rows, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, sizes, of_text = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        of_text[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    groups = collections.Counter()
    for _, t, *_ in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    ordered = [groups[d] for d in sorted(groups)]
    # Smallest possible largest shard: dynamic programming over the cuts.
    upto = np.concatenate(([0], np.cumsum(ordered)))
    best = upto[1:].astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j - 1] if j else 0, upto[i + 1] - upto[j]) for j in range(i + 1)) for i in range(len(ordered))])
    assert max(sizes.values()) == best[-1] and set(slots) <= set(range(shards))


def test_sharding_of_nothing(spark, empty):
    assert sharding.shard_documents(empty).count() == 0


# --- 7 ---
def test_licences(spark, empty):
    texts = ["x\nReleased under the MIT License.\ny", "LICENSED under the apache licence, Version 2.0", "Licensed under CC BY-NC 4.0.", None, "", "word",
             prose(300) + "\nThis work is licensed under the GNU General Public License, version 3!", prose(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licence", F.lit("?"))
    got = {r.doc_id: r.licence for r in licences.scan_licences(frame).collect()}
    assert got == {0: "MIT", 1: None, 2: "CC-BY-NC-4.0", 3: None, 4: None, 5: None, 6: "GPL-3.0", 7: None}
    assert licences.scan_licences(empty).count() == 0


# --- 8 ---
def brute_counts(text):
    words = (text or "").encode().split()
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(spark, docs, rows, empty):
    got = quality.quality_report(docs).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        n = brute_counts(text)
        want[(doc_id, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])] += 1
    assert collections.Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and quality.quality_report(empty).count() == 0


def test_quality_fences(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng.randrange(40, 90), rng), "en", f"s{i % 3}", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(60, rng).split()), "en", f"s{i % 3}", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("_kept", F.lit(3))
    out = quality.filter_quality(frame)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == set(range(400))


# --- 9 ---
def test_leaks(spark, empty):
    items = [(1, prose(40)), (2, prose(15)), (3, "too short"), (4, None), (5, prose(30))]
    half = " ".join(items[0][1].split()[:20])
    texts = [prose(50) + " " + shout(items[0][1]) + "\n" + prose(20), items[1][1], edited(items[0][1], 1), half + " " + prose(60), prose(200), None, "too short",
             items[4][1] + " " + items[1][1], prose(3)]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, items[0][1])], "doc_id long, text string").withColumn("n", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.start for r in decontaminate.leaks(frame, bench).collect()}
    assert got.keys() - {(2, 1)} == {(0, 1), (1, 2), (7, 5), (7, 2)} and got[0, 1] == 50 and got[7, 2] == 30
    kept = decontaminate.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {3, 4, 5, 6, 8, None} <= {r.doc_id for r in kept.collect()}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0


# --- 10 ---
def brute_repeats(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    times = collections.Counter(d[p:p + length] for _, d in data for p in range(len(d) - length + 1))
    out = collections.Counter()
    for doc_id, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if times[d[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(d)))
        rest = bytes(x for x, g in zip(d, gone) if not g)
        out[doc_id, len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")] += 1
    return out


@pytest.mark.parametrize("length", [400, 97])
def test_repeats(spark, docs, rows, length):
    assert collections.Counter(tuple(r) for r in suffix.remove_repeats(docs, length).collect()) == brute_repeats(rows, length)


def test_dedup_passages(spark, docs, rows, empty):
    out = suffix.dedup_passages(docs, 240)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.columns == docs.columns and 0 not in got and 60 not in got and got[10].text == rows[10][1]
    assert all(r.n_chars == len(r.text) for r in (got[65], got[66])) and len(got[65].text) < len(rows[65][1]) - 400
    blanks = spark.createDataFrame([(i, rows[65][1] + end) for i, end in enumerate(("\n\n", "\t\n", "\x0b\r "))], "doc_id long, text string")
    left = suffix.dedup_passages(blanks, 240).collect()
    assert all(r.text.strip() for r in left)
    assert suffix.dedup_passages(empty, 240).count() == 0 and suffix.remove_repeats(empty).count() == 0


# --- pipeline ---
def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    passage, item = prose(70, rng), prose(40, rng)
    good = [prose(rng.randrange(80, 200), rng) for _ in range(120)]
    rows = list(enumerate(good)) + [(200, good[0]), (201, edited(good[1], 1, rng)), (202, "### $$$ " * 60), (203, "few words"),
                                    (204, prose(60, rng) + " " + item + " " + prose(60, rng)), (205, prose(60, rng) + " " + passage),
                                    (206, passage + " " + prose(60, rng)), (207, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*range(120), 205, 206}
    assert max(r.offset + r.length for r in out) <= 1024
