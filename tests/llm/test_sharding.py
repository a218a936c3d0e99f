import heapq
import random
import zlib
from collections import Counter, defaultdict

from skytrail.llm import sharding


def plain(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(x for x, _ in heap)


def test_schedule_is_that_of_items_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        shards = rng.choice((1, 2, 5, 24))
        counts = {rng.choice((0, 1, 2, 7, 50, 51, 1000, 4095, 4096, 70_001, 70_002)): rng.randrange(1, 400) for _ in range(rng.randrange(1, 6))}
        load, seen = defaultdict(int), Counter()
        for size, lo, hi, s in sharding.schedule(sorted(counts.items(), reverse=True), shards):
            assert lo == seen[size] and hi > lo
            seen[size] = hi
            load[s] += size * (hi - lo)
        assert dict(seen) == counts
        assert sorted(load[s] for s in range(shards)) == plain([x for x, n in counts.items() for _ in range(n)], shards)


def check(rows, texts, shards):
    slots = defaultdict(list)
    where = {}
    for r in rows:
        slots[r.shard].append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t)) and 0 <= r.shard < shards
        assert where.setdefault(t, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_documents(documents):
    rows = sharding.shard_by_size(documents).collect()
    check(rows, {r.doc_id: r.text for r in documents.collect()}, 24)
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    groups = Counter()
    for r in documents.collect():
        groups[r.text] += len((r.text or "").encode()) + 8
    assert max(loads.values()) - min(loads.values()) <= max(max(groups.values()) - sum(groups.values()) / 24, 0.01 * sum(groups.values()) / 24 + 4096)


def test_odd_rows(odd, none):
    check(sharding.shard_by_size(odd, 3).collect(), {r.doc_id: r.text for r in odd.collect()}, 3)
    assert sharding.shard_by_size(none).collect() == []


def test_large_sizes_are_not_rounded(spark):
    """Loads are those of plain LPT over the true sizes, which go from 4 KB to 400 KB, with copies and ties."""
    rng = random.Random(4)
    texts = [chr(97 + i % 26) * rng.randrange(4000, 400_000) for i in range(150)] + ["tie" + chr(65 + i) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts + texts[::7])]
    got = sharding.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, dict(rows), 24)
    loads, groups = Counter(), Counter()
    for r in got:
        loads[r.shard] += r.size
    for _, t in rows:
        groups[t] += len(t) + 8
    assert sorted(loads[s] for s in range(24)) == plain(list(groups.values()), 24)
