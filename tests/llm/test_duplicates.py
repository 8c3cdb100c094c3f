"""SimHash groups, repeated bytes and decontamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from sluice.llm import decontaminate, simhash, suffixdedup

from .fixtures import awkward, awkward_docs, clashing, empty_docs, prose, rows_of


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    codes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def plain_components(codes):
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            for j in range(len(codes)):
                if (codes[i] ^ codes[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_groups(spark):
    got = rows_of(simhash.near_duplicates(clashing(awkward_docs(spark))), "doc_id", "fingerprint", "component_id")
    rows = awkward()
    codes = [plain_fingerprint(t) for _, t, *_ in rows]
    label = plain_components(codes)
    least = {}
    for (i, *_), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    assert got == sorted(((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, codes, label)), key=repr)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def near_codes(seed, count):
    """Clusters, chains and lone codes."""
    rnd = random.Random(seed)
    codes = {rnd.getrandbits(64) for _ in range(count)}
    for _ in range(20):
        centre = rnd.getrandbits(64)
        for _ in range(count // 10):
            code = centre
            for _ in range(rnd.randint(0, 4)):
                code ^= 1 << rnd.randrange(64)
            codes.add(code)
    return np.array(sorted(codes), dtype=np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_every_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 97)  # many pieces
    codes = near_codes(seed, 300)
    index = simhash.GrayIndex(np.zeros(len(codes), dtype=np.int64), codes)
    got = {tuple(sorted((int(index.codes[a]), int(index.codes[b])))) for x, y in index.links(2) for a, b in zip(x, y)}
    want = {(int(codes[i]), int(codes[j])) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2) if i < j}
    assert got == want


def test_neighbours_in_gray_order_differ_in_one_bit():
    codes = np.arange(1 << 12, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_chains_across_blocks_are_one_component(spark):
    # Each step flips two bits in other blocks, so that the ends share nothing.
    code, chain = 0, [0]
    for a, b in zip(range(0, 32), range(63, 31, -1)):
        code ^= 1 << a | 1 << b
        chain.append(code)
    signed = [(i, int(np.array(c, np.uint64).view(np.int64))) for i, c in enumerate(chain)]
    got = simhash.grouped(spark.createDataFrame(signed, "doc_id long, fingerprint long"))
    assert {r["component_id"] for r in got.collect()} == {0}


def plain_removal(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def passages(seed):
    """Texts that share passages of lengths around the limit, with edges inside and outside of copies."""
    rnd = random.Random(seed)
    base = [prose(100 * seed + i, 80) for i in range(6)]
    made = []
    for i in range(25):
        parts = [prose(1000 * seed + i, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            t = rnd.choice(base)
            a = rnd.randint(0, 100)
            parts += [t[a:a + rnd.choice([150, 199, 200, 201, 230, 300, 420])], prose(rnd.getrandbits(30), rnd.randint(0, 4))]
        made.append("".join(parts))
    return [*made, "", "x" * 700, "xy" * 300, "xyz" * 150 + "q" + "xyz" * 150]


@pytest.mark.parametrize("crowd", [50_000, 2])
def test_repeated_bytes(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    texts = [t for seed in range(3) for t in passages(seed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = rows_of(suffixdedup.measured(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *r) for i, r in enumerate(plain_removal([t.encode() for t in texts], 200))), key=repr)


def test_repeated_bytes_of_awkward_rows(spark):
    got = rows_of(suffixdedup.measured(clashing(awkward_docs(spark))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = awkward()
    want = plain_removal([(t or "").encode() for _, t, *_ in rows], 200)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert suffixdedup.measured(empty_docs(spark)).count() == 0


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 500)
    texts = [prose(1, 900), prose(2, 50) + prose(1, 900)[700:2500], prose(3, 300)]
    rows = [(i, p - far, p - near) for i, t in enumerate(texts) for s, part in suffixdedup._pieces(t.encode())
            for _, p, near, far in zip(*(a.tolist() for a in suffixdedup.anchors(part, s)))]
    for i, t in enumerate(texts):  # every window start belongs to one anchor
        starts = sorted(x for j, a, b in rows if j == i for x in range(a, b + 1))
        assert starts == list(range(len(t.encode()) - 199))


@pytest.mark.parametrize("cuts", [[], [9], [5, 12, 20]])
def test_merged_transforms_find_the_same_repeats(cuts):
    texts = [t.encode() for t in passages(7)]
    bounds = [0, *cuts, len(texts)]
    shards = [texts[a:b] for a, b in zip(bounds, bounds[1:])]
    seen = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want = [(s, k, i) for s, shard in enumerate(shards) for k, t in enumerate(shard) for i in range(len(t) - 199) if seen[t[i:i + 200]] > 1]
    assert suffixdedup.merged_repeats(shards) == want


def test_kept_texts(spark):
    docs = clashing(awkward_docs(spark))
    left = suffixdedup.without_repeats(docs)
    assert left.columns == docs.columns
    kept = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert (3, prose(3, 80)) in kept and (4, None) in kept and (5, "") in kept
    assert not any(i in (1, 2, 12) for i, _ in kept)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i:i + 10])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a:a + size]) in windows:
                    hit |= set(range(a, a + size))
                    found |= windows[tuple(w[a:a + size])]
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=repr)


ITEMS = [(1, prose(50, 40)), (2, prose(51, 9)), (3, "one short"), (4, ""), (5, None), (6, prose(50, 40)), (10, "ß"), (12, prose(52, 12))]


def contaminated_docs():
    rnd, made = random.Random(4), []
    for i in range(40):
        t = prose(500 + i, 60)
        for _ in range(rnd.randint(0, 3)):
            w = (rnd.choice([x for _, x in ITEMS if x]) or "").split()
            a = rnd.randint(0, len(w))
            t += rnd.choice([" ", "\n", "--"]) + rnd.choice(["  ", " "]).join(w[a:a + rnd.randint(1, 30)]).upper()
        made.append((i, t))
    return [*made, (100, None), (101, ""), (102, "One, SHORT"), (103, "one shorts"), (None, ITEMS[0][1]), (104, ITEMS[0][1]), (104, ITEMS[0][1])]


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_hits(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(contaminated_docs(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows_of(decontaminate.contaminated(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    assert got == plain_hits(contaminated_docs(), ITEMS)


def test_hits_of_awkward_tables(spark):
    items = spark.createDataFrame([(1, prose(2, 120)), (None, "one"), (2, None)], "item_id long, text string")
    docs = clashing(awkward_docs(spark))
    got = rows_of(decontaminate.contaminated(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    assert got == plain_hits([(r[0], r[1]) for r in awkward()], [(1, prose(2, 120))])
    none = items.where("item_id < 0")
    assert decontaminate.contaminated(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contaminated(empty_docs(spark), items).count() == 0


def test_words_are_split_in_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    text = prose(9, 50)
    assert [w for part in decontaminate.words_of(text) for w in part] == [w.encode() for w in words_of(text)]


def test_longest_matches(spark):
    item = "a0 a1 a2 a3 a4 a5 a6 a7 a8 a9 b0 b1 b2 b3 b4"
    docs = spark.createDataFrame([(1, "x " + item[:38] + " y " + item), (2, "q"), (3, "tiny Thing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "tiny thing")], "item_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in decontaminate.longest_matches(docs, items).collect()}
    assert got == {1: [("7", 0, 1, 13), ("7", 0, 15, 15)], 3: [("8", 0, 0, 2)]}
