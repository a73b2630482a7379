"""Exact, SimHash and passage duplicates against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemill.llm import exact_dedup, simhash_neardup, substring_dedup
from tidemill.llm.common import connected_components, materialize, shared_root


def lower(text):
    return (text or "").encode("utf-8", "surrogatepass").lower()


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lower(text)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = True
        for i in ids:
            kept = i == keep and stays
            stays = stays and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(text).hexdigest()] += 1
    return out


def test_exact_dedup_on_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = Counter(tuple(r) for r in exact_dedup.find_duplicates(spark, awkward, capacity=1000).drop("raw").collect())
    assert got == brute_exact(rows)
    assert exact_dedup.find_duplicates(spark, nothing).count() == 0


def test_exact_dedup_stage_keeps_one_row_and_all_columns(spark, awkward, nothing):
    kept = exact_dedup.keep_distinct(spark, awkward, "")
    assert kept.columns == awkward.columns
    texts = [lower(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r["text"]) for r in awkward.collect()})
    assert exact_dedup.keep_distinct(spark, nothing, "").count() == 0


def test_directory_splits_and_doubles():
    rng = random.Random(2)
    keys = [rng.getrandbits(64) for _ in range(3000)] + [rng.getrandbits(40) for _ in range(500)]

    def count(prefixes, bits):
        out = {}
        for k in keys:
            if any(b == 0 or k >> (64 - b) == v for b, v in prefixes):
                size, n = out.get(k >> (64 - bits), (0, 0))
                out[k >> (64 - bits)] = size + 1, n + 1
        return out

    directory = exact_dedup.build_directory(count, capacity=60, max_bits=30, step=4)
    found = directory.find(np.array(keys, np.uint64))
    by_bucket = Counter(found.tolist())
    assert max(n for b, n in by_bucket.items()) <= 60 or max(b for b, _ in directory.buckets) >= 24
    for key, bucket in zip(keys, found.tolist(), strict=True):
        bits, value = directory.buckets[bucket]
        assert key >> (64 - bits) == value
    assert len(directory.slots) == 1 << directory.depth
    same = exact_dedup.build_directory(lambda p, bits: {5: (10**9, 1)}, capacity=10)
    assert same.depth == 0


def test_colliding_keys_form_chains():
    import pyarrow as pa

    rows = [(0, 7, b"a", 1, 1, 1), (0, 7, b"b", 5, 1, 2), (0, 7, b"a", 3, 1, 1), (0, 9, b"a", None, 1, 1)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "text", "high", "at_high", "n"])
    # the chain of key 7 spans two batches
    out = [r for b in exact_dedup._chain(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["key"], r["link"], r["keep_id"], r["n"]) for r in out] == [(7, 0, 3, 2), (7, 1, 5, 2), (9, 0, None, 1)]


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s, seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash_on_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    prints = [brute_fingerprint(t) if len(t or "") < 100_000 else simhash_neardup.fingerprint(lower(t).split()) for _, t in rows]
    want = Counter(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints), strict=True))
    assert Counter(tuple(r) for r in simhash_neardup.near_duplicates(spark, awkward).collect()) == want
    assert simhash_neardup.near_duplicates(spark, nothing).count() == 0


def test_long_texts_are_counted_in_parts(prose):
    words = lower(prose(70_000)).split()
    assert simhash_neardup.fingerprint(words[:40_000]) == brute_fingerprint(" ".join(w.decode() for w in words[:40_000]))


def test_anchors_find_all_pairs_within_three_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for _ in range(rng.randint(0, 6)):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    # a tight cluster, more than a small group holds
    prints |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash_neardup.link_fingerprints(spark, spark.createDataFrame([(p,) for p in signed], "fp long"))
    ids = {s: i for i, s in enumerate(signed)}
    rows = links.collect()
    for r in rows:
        assert bin((r["u"] ^ r["v"]) & (2**64 - 1)).count("1") >= 1
    roots = {r["node"]: r["root"] for r in connected_components(spark, links).collect()}
    got = [ids[roots.get(s, s)] for s in signed]
    want = brute_components(list(range(len(prints))), prints)
    canon = lambda labels: [labels.index(x) for x in labels]
    assert canon(got) == canon(want)
    assert len(rows) < 20 * len(prints)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5), (300, None)]
    got = {r["node"]: r["root"] for r in connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200, 202: 200}
    assert connected_components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_stage(spark, awkward, nothing):
    kept = simhash_neardup.keep_one(spark, awkward, "")
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 6 not in ids and 5 in ids
    assert simhash_neardup.keep_one(spark, nothing, "").count() == 0


def test_simhash_stage_knows_a_document_by_id_and_text(spark, prose):
    """A near copy that goes takes no other document of its doc_id, or without one, along."""
    a, b, c, d, e = (prose(200) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, c), (7, d), (7, e), (8, d), (9, a), (9, b + " x"), (7, d)]
    kept = simhash_neardup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    prints = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    near = simhash_neardup.fingerprint
    alike = (near((b + " x").encode().split()) ^ near(b.encode().split())).bit_count() <= 3
    assert prints == Counter([(1, a), (None, c), (7, d), (7, e), (9, b + " x"), *([] if alike else [(None, b)])])


def test_tokens_are_those_of_the_words(prose):
    """Equal shingles have equal hashes wherever they stand, different ones different hashes; also of long words and texts."""
    rng = random.Random(14)
    texts = ["", " ", "one", "a b c d e", " a  b\tc\nd e ", "a b c d e f", "\x85 x y z v w", prose(30), "x" * 40_000 + " a b c d", prose(60_000), "é ü ß æ ø", "a b c d " + "y" * 70_000]
    texts += [" ".join(rng.choice(texts[7].split()) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    known = {}
    for lists in (substring_dedup.token_lists(pa.array(texts)), substring_dedup.token_lists(pa.array(["no", *texts])[1:])):
        for text, own in zip(texts, lists, strict=True):
            words = text.encode().split()
            assert len(own) == max(0, len(words) - 4)
            for i, h in enumerate(own.tolist()):
                assert known.setdefault(tuple(words[i : i + 5]), h) == h
    assert len(set(known.values())) == len(known)


def test_compact_windows_hold_every_passage():
    """Each stretch of the least width or more is in exactly the window of its own smallest token."""
    rng = np.random.default_rng(6)
    sizes = [40, 7, 0, 25, 60]
    flat = rng.integers(0, 50, sum(sizes)).astype(np.uint64)
    starts = np.cumsum([0, *sizes[:-1]])
    width = 8
    windows = list(substring_dedup.compact_windows(flat, starts, width, 2))
    for f, hashed, owner, left, centre, right in windows:
        for t, (s, n) in enumerate(zip(starts.tolist(), sizes, strict=True)):
            own = substring_dedup._mix(flat[s : s + n], f + 1) >> np.uint64(20)
            mine = [(a, c, b) for o, a, c, b in zip(owner, left, centre, right, strict=True) if o == t]
            for i in range(n):
                for j in range(i + width - 1, n):
                    least = int(np.argmin(own[i : j + 1])) + i
                    held = [c for a, c, b in mine if a <= i <= c <= j <= b]
                    assert held == [least]


def passages(rows, k=50):
    """Documents that share ``k`` words in a row with another."""
    seen, out = defaultdict(set), set()
    for i, t in rows:
        w = lower(t).split()
        for j in range(len(w) - k + 1):
            seen[tuple(w[j : j + k])].add(i)
    for ids in seen.values():
        if len(ids) > 1:
            out |= ids
    return out


def test_passages_against_brute_force(spark, prose):
    rng = random.Random(9)
    shared = [prose(70), prose(55), prose(120)]
    rows = [(i, prose(rng.randint(5, 300))) for i in range(60)]
    for i in range(0, 40):
        p = shared[i % 3] if i % 4 else prose(49)
        rows[i] = (i, f"{prose(rng.randint(0, 80))} {p} {prose(rng.randint(0, 80))}".strip())
    rows += [(100, rows[50][1]), (101, rows[50][1].upper()), (102, prose(49)), (102, None)]
    edited = shared[2].split()
    edited[60] = "changed"
    rows.append((103, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.find_passages(spark, docs).collect()
    got = {r["doc_id"] for r in found}
    want = passages(rows)
    assert want <= got and got - want <= {103}
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(lower(t).split())
    for r in found:
        a, b = text[r["doc_id"]][0][r["start_word"] : r["end_word"] + 1], text[r["other_id"]][0][r["other_start"] : r["other_end"] + 1]
        x, y = set(zip(*(a[k:] for k in range(5)), strict=False)), set(zip(*(b[k:] for k in range(5)), strict=False))
        assert len(a) >= 50 and len(b) >= 50 and len(x & y) / len(x | y) >= 0.8 - 1e-9


def test_passages_whose_ends_occur_twice():
    """The last 15 of 60 shared words stand 20 words before the passage in B as well."""
    rng = np.random.default_rng(3)
    p, gap, rest = (rng.integers(1, 1 << 60, n).astype(np.uint64) for n in (56, 20, 80))
    a = np.r_[rest[:40], p, rest[40:60]]
    for b in (np.r_[p[-11:], gap, p], np.r_[p, gap, p[:11]], np.r_[p[-11:], gap, p, gap, p[:11]]):
        for x, y in ((a, b), (b, a)):
            got = substring_dedup.matching_passages(x, y, 46)
            assert got and max(e - s for s, e, *_ in got) >= 56 and max(e - s for _, _, s, e, _ in got) >= 56


def test_all_windows_of_a_task_go_on(prose):
    """Texts of one task that share passages with each other send as many windows as any text."""
    import pyarrow as pa

    shared = [prose(60) for _ in range(3)]
    texts = [f"{prose(40)} {p} {prose(40)}" for p in shared] + [" ".join(f"{p} {prose(30)}" for p in shared)]
    send = lambda some: sum(b.num_rows for b in substring_dedup._window_rows(5, 50, 6)([pa.RecordBatch.from_arrays([pa.array(some)], names=["text"])]))
    assert send(texts) == sum(send([t]) for t in texts)


def test_partners_that_are_neither_first_nor_next(spark, prose):
    """Hundreds of copies with their own edits: whatever any pair matches in is found."""
    rng = random.Random(21)
    base, rows = prose(54).split(), []
    for i in range(240):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            words[rng.randrange(len(words))] = f"own{i}x{rng.randint(0, 999)}"
        rows.append((i, " ".join(words)))
    own = dict(zip([i for i, _ in rows], substring_dedup.token_lists(pa.array([t for _, t in rows])), strict=True))
    want = {k for i in own for j in own if i < j and substring_dedup.matching_passages(own[i], own[j], 46) for k in (i, j)}
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == want and len(want) > 20


def test_pairs_match_around_a_window_that_waits():
    """In the last round a pair is looked at only if what it shares is where a window of either text waits for a match."""
    rng = np.random.default_rng(5)
    p, *rest = (rng.integers(1, 1 << 60, 60 if i == 0 else 100).astype(np.uint64) for i in range(3))
    x, y = np.r_[rest[0], p], np.r_[p, rest[1]]

    def rows(*waiting):
        columns = [[1], [1000], [2], [3000], [x.tobytes()], [y.tobytes()], *([w] for w in waiting)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i > 5 else None) for i, c in enumerate(columns)], names=[f"c{i}" for i in range(len(columns))])
        return [tuple(r.values()) for b in substring_dedup._verify(5, 46, 0.8)([batch]) for r in b.to_pylist()]

    want = [(1, 2, 1100, 1163, 3000, 3063, 1.0)]
    assert rows() == want
    assert rows([1010, 1130], []) == rows([], [3010]) == rows([1010], [3059]) == want
    assert rows([1010], [3140]) == rows([], []) == rows([1090], [3070]) == []


def test_windows_with_the_same_tokens_around_them():
    rng = np.random.default_rng(6)
    same, *rest = (rng.integers(1, 1 << 60, 117 if i == 0 else 90).astype(np.uint64) for i in range(3))
    key = lambda own, at: substring_dedup._contents(own, np.array([at]), 58)[0]
    a, b = np.r_[rest[0], same, rest[1]], np.r_[rest[1][:7], same, rest[0]]
    assert key(a, 90 + 58) == key(b, 7 + 58)
    assert len({key(a, 90 + 58), key(a, 90 + 57), key(b, 7 + 59), key(same[1:], 57), key(same[:-1], 58)}) == 5


def test_edited_copies_beside_their_source(spark, prose):
    """A text holds a passage and an edited copy of it; other texts hold the passage too, so the copy matches these."""
    base, rows = prose(54).split(), []
    for i in range(12):
        words = list(base)
        words[20 + i] = f"edit{i}"
        rows.append((i, f"{prose(30)} {' '.join(base)} {prose(80)} {' '.join(words)} {prose(30)}"))
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["start_word"] <= 170 and r["end_word"] >= 200} == set(range(12))


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_table_that_they_made(spark):
    before = shuffle_files(spark)
    out = materialize(spark, spark.range(5_000, numPartitions=4).repartition(3, "id"), "dealt")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 5_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tables_that_nothing_reads_any_more_are_gone(spark, prose):
    """Near copies among exact ones, so that all steps are taken; the rows are there all the same."""
    base = prose(300).split()
    rows = [(i, " ".join([*(f"own{i}x{j}" for j in range(40)), *base[: 80 + i], *(f"tail{i}x{j}" for j in range(40))])) for i in range(6)]
    for i in range(6, 30):
        words = base[200:254]
        words[10 + i] = f"w{i}"
        rows.append((i, " ".join(words)))
    folder = Path(shared_root(spark).removeprefix("file://")) / "tidemill"
    before = set(folder.iterdir()) if folder.exists() else set()
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert {r["doc_id"] for r in found.collect()} >= set(range(6))
    assert "passages-exact" in kinds and not kinds & {"passage-texts", "passage-segments", "passage-near", "passage-tokens", "passage-sketches", "passage-roots"}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_versions_of_a_template_find_their_own_copies(spark, prose, partitions):
    """Thirty versions of a passage, two documents each with 58 words in common, which share phrases with all others."""
    rng = random.Random(77)
    base, rows = prose(58).split(), []
    for v in range(30):
        words = list(base)
        for at in rng.sample(range(58), 6):
            words[at] = f"version{v}word{at}"
        for k in range(2):
            rows.append((2 * v + k, f"{prose(rng.randint(20, 60))} {' '.join(words)} {prose(rng.randint(20, 60))}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = substring_dedup.find_passages(spark, docs).collect()
    assert {r["doc_id"] for r in found} == set(range(60))
    pairs = {(r["doc_id"], r["other_id"]) for r in found if r["end_word"] - r["start_word"] >= 57}
    assert {(2 * v, 2 * v + 1) for v in range(30)} <= pairs | {(b, a) for a, b in pairs}


def test_recall_of_near_repeats(spark, prose):
    """Passages with one to three words changed, added or left out, in other texts: what brute force matches is found."""
    rng, rows = random.Random(5), []
    for i in range(120):
        words = prose(rng.randint(55, 140)).split()
        other = list(words)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(other))
            how = rng.randrange(3)
            if how == 0:
                other[at] = f"changed{i}"
            elif how == 1:
                other.insert(at, f"added{i}")
            else:
                del other[at]
        rows += [(2 * i, f"{prose(rng.randint(0, 50))} {' '.join(words)} {prose(rng.randint(0, 50))}"), (2 * i + 1, f"{prose(rng.randint(0, 50))} {' '.join(other)} {prose(rng.randint(0, 50))}")]
    own = dict(zip([i for i, _ in rows], substring_dedup.token_lists(pa.array([t for _, t in rows])), strict=True))
    want = {i for i in own if substring_dedup.matching_passages(own[i], own[i ^ 1], 46) or substring_dedup.matching_passages(own[i ^ 1], own[i], 46)}
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"] for r in found}
    assert len(want) > 180 and len(want & got) >= 0.98 * len(want)
    assert all(r["other_id"] == r["doc_id"] ^ 1 for r in found)


def test_near_repeats_of_passages_that_exact_repeats_hold(spark, prose):
    """Each version of a passage stands in two texts as it is, so all its windows are held; versions still match each other."""
    rows, versions = [], []
    for p in range(6):
        words = prose(60).split()
        edited = list(words)
        edited[30] = f"edited{p}"
        versions.append((words, edited))
        for v, some in enumerate((words, edited)):
            rows += [(4 * p + 2 * v + k, f"{prose(40)} {' '.join(some)} {prose(40)}") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.with_classes(spark, substring_dedup.find_passages(spark, docs)).collect()
    near = {frozenset((r["doc_id"] // 2, r["other_id"] // 2)) for r in found if r["doc_id"] // 2 != r["other_id"] // 2}
    assert near == {frozenset((2 * p, 2 * p + 1)) for p in range(6)}
    assert {(r["doc_id"], r["class_id"]) for r in found} == {(4 * p + k, 4 * p) for p in range(6) for k in range(4)}


def test_repeated_words_are_one_window(spark):
    """A word again and again, fewer than fifty times, and lines again and again, beside other texts."""
    rows = [(i, " ".join(["word"] * (30 + i) + [f"own{i}x{k}" for k in range(80)])) for i in range(12)]
    rows += [(100 + i, " ".join(["the same line of nine words comes again here"] * 12 + [f"rest{i}x{k}" for k in range(40)])) for i in range(6)]
    rows += [(200, " ".join(["solo"] * 400)), (201, " ".join(["solo"] * 500 + ["end"]))]
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == passages(rows) == {100, 101, 102, 103, 104, 105, 200, 201}


def test_texts_without_ids_link_others(spark, prose):
    shared = prose(80)
    rows = [(None, shared), (1, f"{prose(30)} {shared}"), (2, f"{shared} {prose(30)}"), (None, prose(90))]
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {1, 2}


def test_very_long_texts_are_cut_into_segments(spark, prose):
    """Passages longer than a segment, and repeats that lie across the places where segments are cut."""
    long = prose(3 * substring_dedup.SEGMENT)
    words = long.split()
    rows = [(1, long), (2, " ".join(words[:9000]) + " " + prose(300)), (3, prose(100) + " " + " ".join(words[4050:4150]) + " " + prose(50))]
    found = substring_dedup.find_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in found if r["doc_id"] == 2 for w in range(r["start_word"], r["end_word"] + 1)}
    assert set(range(9000)) <= covered and {r["doc_id"] for r in found} == {1, 2, 3}
    assert any(r["start_word"] <= 100 and r["end_word"] >= 199 for r in found if r["doc_id"] == 3)


def test_passages_on_awkward_rows(spark, awkward, nothing):
    got = substring_dedup.find_passages(spark, awkward)
    assert {r["doc_id"] for r in got.collect()} == {5, 6}
    assert substring_dedup.find_passages(spark, nothing).count() == 0


def test_pairs_are_sifted_without_sorting_all_their_tokens(monkeypatch):
    rng = np.random.default_rng(4)
    xs = [rng.integers(0, 1 << 62, 120).astype(np.uint64) for _ in range(40)]
    ys = [x.copy() if i % 8 == 0 else rng.integers(0, 1 << 62, 120).astype(np.uint64) for i, x in enumerate(xs)]
    columns = [pa.array(range(40), pa.int64()), pa.array([0] * 40, pa.int64()), pa.array(range(100, 140), pa.int64()), pa.array([5] * 40, pa.int64()), pa.array([x.tobytes() for x in xs]), pa.array([y.tobytes() for y in ys])]
    sizes, isin = [], np.isin
    monkeypatch.setattr(np, "isin", lambda a, b, **more: sizes.append(len(a)) or isin(a, b, **more))
    rows = [r for out in substring_dedup._verify(5, 46, 0.8)([pa.RecordBatch.from_arrays(columns, names=list("abcdef"))]) for r in out.to_pylist()]
    assert [(r["a"], r["b"], r["a_start"], r["a_end"], r["b_start"], r["b_end"], r["similarity"]) for r in rows] == [(i, 100 + i, 0, 123, 5, 128, 1.0) for i in range(0, 40, 8)]
    # all pairs of a batch are looked up in a hash table; only those that are left are compared one by one
    assert max(sizes) == 120
