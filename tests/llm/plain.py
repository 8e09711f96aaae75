"""What operators must find, in plain Python."""

import re

import xxhash


def brute_fingerprint(text, words):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts = re.findall("[^\x20\x09-\x0D]+", lower)
    found = [" ".join(parts[k:k + words]) for k in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius):
    """For each row the smallest id that links of up to ``radius`` bits reach."""
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min(ids[k] for k in range(len(ids)) if group[k] == g) for g in group]
