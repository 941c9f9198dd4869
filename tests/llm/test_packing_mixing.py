import random

import pytest

from quarrylens.llm.mixing import mix, pfair_schedule, share_report
from quarrylens.llm.packing import bucket_bounds, fill_report, pack, pack_items
from quarrylens.llm.tokens import TOKENIZER_DIR, VOCABULARY, encode, encoder, token_counts

DOC = "doc_id long, text string, source string, n_tokens long, fill double, slot string"
PATH = f"{TOKENIZER_DIR}/{VOCABULARY}"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 0.5, "x") for i, t, s in rows], DOC)


def padding(histogram, bounds):
    return sum((min(b for b in bounds if b >= n) - n) * c for n, c in histogram.items())


def best_padding(histogram, k):
    from itertools import combinations

    lengths = sorted(histogram)
    return min(padding(histogram, [*c, lengths[-1]]) for r in range(k) for c in combinations(lengths[:-1], r))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(0, 60): rng.randint(1, 20) for _ in range(9)}
    for k in (1, 2, 4):
        bounds = bucket_bounds(histogram, k)
        assert len(bounds) <= k and padding(histogram, bounds) == best_padding(histogram, k)
    assert bucket_bounds({}, 3) == []


def test_pack_items_fill():
    rng = random.Random(1)
    lengths = [min(2048, int(rng.paretovariate(1.1) * 40)) for _ in range(5000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    places = pack_items(lengths, bucket_bounds(histogram, 24), 2048)
    used = {}
    for n, c in zip(lengths, places):
        used[c] = used.get(c, 0) + n
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert sum(lengths) / (2048 * len(used)) > 0.9


def test_pack_on_spark(spark):
    long = "word and more words, " * 2000
    rows = [(i, "some text " * (i % 40 + 1), "a") for i in range(400)] + [(1000, long, "a"), (1001, None, "b"), (1002, "", None), (1003, "same", "a"), (1003, "same", "a")]
    df = docs(spark, rows)
    packed = pack(df).collect()
    sizes, seen = {}, {}
    for r in packed:
        sizes[r["container_id"]] = sizes.get(r["container_id"], 0) + r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["piece_no"], r["token_start"], r["n_tokens"]))
    assert max(sizes.values()) <= 2048 and all(sizes[r["container_id"]] == r["container_tokens"] for r in packed)
    n = len(encode(long, PATH))
    pieces = sorted(seen[1000])
    assert [p[0] for p in pieces] == list(range(-(-n // 2048))) and sum(p[2] for p in pieces) == n and pieces[1][1] == 2048
    assert len(seen[1003]) == 2 and seen[1001] == [(0, 0, 0)] and seen[1002] == [(0, 0, 0)] and all(len(v) == 1 for k, v in seen.items() if k < 1000)
    small = fill_report(pack(df, shard_tokens=3000)).first()
    assert small["n_pieces"] == len(packed) and small["n_tokens"] == sum(sizes.values())
    assert pack(df.limit(0)).count() == 0


def test_tokens_round_trip(spark):
    texts = ["héllo wörld", "日本語のテキスト", "a" * 5000, "  \n\t x  ", "emoji 😀 end", "<|endoftext|>"]
    for t in texts:
        assert encoder(PATH).decode(encode(t, PATH)) == t
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs(spark, [(i, t, "s") for i, t in enumerate([*texts, None])])).collect()}
    assert got == {**{i: len(encode(t, PATH)) for i, t in enumerate(texts)}, len(texts): 0}


@pytest.mark.parametrize("blocks", [{"a": 3, "b": 5, "c": 2}, {"a": 1, "b": 99}, {"a": 7}, {"a": 33, "b": 33, "c": 34}, {"a": 17, "b": 0, "c": 120, "d": 4}])
def test_pfair_deviates_less_than_a_block(blocks):
    order = pfair_schedule(blocks)
    total = sum(blocks.values())
    assert len(order) == total
    given = dict.fromkeys(blocks, 0)
    for slot, (source, number) in enumerate(order, 1):
        assert number == given[source]
        given[source] += 1
        assert all(abs(given[s] - slot * n / total) < 1 for s, n in blocks.items())
    assert given == blocks


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "plain words here " * rng.randint(1, 9), "big") for i in range(900)] + [(i, "tiny text now " * rng.randint(1, 5), "small") for i in range(900, 960)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "x", None), (2003, "x", "unknown"), (5, rows[5][1], "big")]
    df = docs(spark, rows)
    targets = spark.createDataFrame([("big", 0.7, 1, 1), ("small", 0.2, 4, 1), ("absent", 0.1, 2, 1), (None, 0.5, 1, 1), ("unknown", 0.0, 3, 1)],
                                    "source string, target_share double, max_repeats int, n_tokens int")
    mixed = mix(df, targets, block_tokens=200)
    picked = mixed.collect()
    counts, tokens = {}, {}
    for r in picked:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert set(tokens) == {"big", "small"} and max(v for k, v in counts.items() if k >= 900) <= 4 and max(v for k, v in counts.items() if k < 900 and k != 5) == 1
    whole = sum(tokens.values())
    assert abs(tokens["big"] / whole - 7 / 9) < 0.01
    done = {"big": 0, "small": 0}
    for r in sorted(picked, key=lambda r: (r["slot"], r["start"])):
        done[r["source"]] += r["n_tokens"]
        assert abs(done["big"] - sum(done.values()) * 7 / 9) < 2 * 200 + 100
    report = {r["source"]: r for r in share_report(mixed, targets.filter("source IS NOT NULL")).collect()}
    assert report["absent"]["n_tokens"] == 0 and abs(report["small"]["actual_share"] - 2 / 9) < 0.01 and report["small"]["repeats_used"] <= 4
    assert mix(df.limit(0), targets).count() == 0 and mix(df, targets.limit(0)).count() == 0


def test_batches_inside_buckets():
    import random

    rng = random.Random(2)
    lengths = [rng.choice([100, 400, 900, 1500]) for _ in range(400)]
    bounds = [100, 400, 900, 1500]
    for top_up in (True, False):
        places = pack_items(lengths, bounds, 2048, top_up)
        used, kinds = {}, {}
        for n, c in zip(lengths, places):
            used[c] = used.get(c, 0) + n
            kinds.setdefault(c, set()).add(n)
        assert max(used.values()) <= 2048 and (top_up or all(len(k) == 1 for k in kinds.values()))
