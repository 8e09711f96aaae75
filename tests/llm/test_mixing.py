"""The mix against a schedule played slot by slot, and against its rules."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from holdfast.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes: dict, weights, most):
    """Targets by sharing again and again, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        left = total - sum(held.values())
        open_ = [s for s in names if s not in held]
        share = {s: Fraction(w[s] * left, sum(w[x] for x in open_)) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return names, {**held, **share}
        held |= {s: Fraction(most * sizes[s]) for s in over}


def played(rows, weights, most, block):
    """Per row its words taken; all slots as (slot, source, rank, block, pass, words); words by slot."""
    words = [WORD.findall(t or "") for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), w in zip(rows, words):
        sizes[s] += len(w)
    names, target = level(sizes, weights, most)
    streams = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (
        hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}".encode()).hexdigest(), rows[i][0] or 0, len(words[i])))
    for i in order:
        streams[rows[i][2]] += [(i, w) for w in words[i]]
    goals = {s: (2 * target[s] + 1) // 2 for s in names}
    slots_of = {s: (goals[s] // sizes[s] * -(-sizes[s] // block) + -(-(goals[s] % sizes[s]) // block)) if sizes[s] else 0 for s in names}
    many = sum(slots_of.values())
    bits = max(many - 1, 0).bit_length()
    owner = [s for s in names for _ in range(slots_of[s])]
    taken, rank, slots, text = Counter(), Counter(), [], {}
    for slot in range(1 << bits if many else 0):
        point = int(f"{slot:0{bits}b}"[::-1], 2) if bits else 0
        if point >= many:
            continue
        s = owner[point]
        blocks = -(-sizes[s] // block)
        r, rank[s] = rank[s], rank[s] + 1
        b, lap = r % blocks, r // blocks
        got = streams[s][b * block:(b + 1) * block][:max(0, goals[s] - lap * sizes[s] - b * block)]
        taken.update(i for i, _ in got)
        text[slot] = [w for _, w in got]
        slots.append((slot, names.index(s), r, b, lap, len(got)))
    return sizes, target, taken, slots, text


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows],
                                 "doc_id long, text string, source string, size int, start int")


ROWS = [(i, " ".join(f"w{i}.{j}" for j in range((i * 37) % 61)), "abcd"[(i * i) % 4]) for i in range(60)] + [
    (60, None, "a"), (61, "", None), (62, "one word", None), (63, " \t\n\x0b", ""), (64, "x y", ""), (None, "no id here", "b"),
    (65, "long " * 5000, "hot"), (66, "a b c", "é"), (66, "a b c", "é"), (67, "q", "zz"), (68, "", "void")]


@pytest.mark.parametrize("block, weights, most", [(7, (5, 2, 1), 3), (64, (1,), 2), (10_000, (1, 9), 3)])
def test_mix_is_the_schedule_played_out(spark, block, weights, most):
    mix = mixing.mix(table(spark, ROWS), block_words=block, weights=weights, most=most)
    sizes, target, taken, slots, text = played(ROWS, weights, most, block)
    want = sorted(((str(i), len(WORD.findall(t or "")), sizes[s], float(target[s]), taken[k]) for k, (i, t, s) in enumerate(ROWS)))
    got = mix.taken().collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, r.target, r.taken) for r in got) == want
    assert sorted(tuple(r) for r in mix.slots.select("slot", "source", "rank", "block", "pass", "words").collect()) == sorted(slots)
    read = defaultdict(list)
    for r in sorted(mix.texts(table(spark, ROWS)).collect(), key=lambda r: (r.slot, r["at"])):
        read[r.slot] += r.text.split(" ")
    assert read == {k: v for k, v in text.items() if v}
    for r in got:
        assert r.taken <= most * r["size"]


def test_every_stretch_of_slots_holds_the_shares(spark):
    rows = [(i, "w " * 40, "abc"[i % 3]) for i in range(300)]
    slots = sorted(mixing.mix(table(spark, rows), block_words=16).slots.select("slot", "source").collect())
    share, many = Counter(s for _, s in slots), len(slots)
    for at in range(0, many - 64, 16):
        near = Counter(s for _, s in slots[at:at + 64])
        assert all(abs(near[s] - 64 * share[s] / many) <= 8 for s in share)


def test_no_rows_and_no_words(spark):
    assert mixing.mix(table(spark, ROWS[:0])).taken().count() == 0
    got = mixing.mix(table(spark, [(1, None, None), (2, "", "a"), (2, "", "a")])).taken().collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3


def test_reruns_agree_whatever_the_partitions(spark):
    one, two = (mixing.mix(table(spark, rows).repartition(k), block_words=5).taken().collect()
                for rows, k in ((ROWS, 3), (ROWS[::-1], 7)))
    assert sorted(map(str, one)) == sorted(map(str, two))
