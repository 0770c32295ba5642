"""Recall of the pipeline's near-duplicate stage on edited copies that are planted among clean documents."""

import random
import re

from voxelflow.llm import simhash


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def edited(rng, words, word):
    """A copy with words replaced, put in or taken out at a few places."""
    words = list(words)
    for _ in range(rng.randint(1, max(1, len(words) // 45))):
        at = rng.randrange(len(words))
        words[at : at + rng.choice((0, 1, 1, 2))] = [word() for _ in range(rng.choice((0, 1, 1, 2)))]
    return words


def test_recall_of_edited_copies(spark, table):
    """Documents whose id is divisible by 50 against all rows: the stage finds at least nine in ten of the pairs at 0.8 or more."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    word = lambda: vocabulary[min(int(rng.expovariate(0.004)), 3999)]
    rows, pairs, clean = [], {}, set()
    for k in range(300):
        words = [word() for _ in range(rng.choice((60, 120, 300, 900)))]
        rows.append((50 * k, " ".join(words)))
        clean.add(50 * k)
        for j in range(1, 3):
            copy = " ".join(edited(rng, words, word))
            a, b = shingles(" ".join(words)), shingles(copy)
            rows.append((50 * k + j, copy))
            if copy != " ".join(words) and len(a & b) >= 0.8 * len(a | b):
                pairs[50 * k + j] = 50 * k
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(table(rows)).select("doc_id").collect()}
    found = sum(d not in kept for d in pairs)
    print(f"near copies found: {found} of {len(pairs)}")
    assert len(pairs) > 200 and found >= 0.9 * len(pairs)
    assert clean <= kept
