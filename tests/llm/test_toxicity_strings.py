"""A chunk's strings are made once and valued as sums over their numbers."""

import zlib

import numpy as np
import pyarrow as pa

from caselink.llm import toxicity


def test_a_chunk_spells_each_word_once(monkeypatch):
    words = ["toxic", "word", "a", "w" * 7, "x" * 8, "ordinarily"]
    strings = list(dict.fromkeys(g for w in words for g in toxicity._strings(w)))
    assert toxicity._strings("ordinarily")[-2:] == ["narily", "arily$"] and toxicity._strings("a") == ["^a", "^a$"]
    value = {g: float(np.float16(len(g) - 3.3 + 0.1 * i)) for i, g in enumerate(strings)}
    packs = {}
    for g in strings:  # contexts of a packet by first occurrence, and their letters
        packs.setdefault(zlib.crc32(g[:-1].encode()) % toxicity.PACKETS, {}).setdefault(g[:-1], []).append(value[g])
    pack = lambda x: zlib.compress(np.array(x, "<f2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)
    sent = pa.table({"_n": pa.array([-1, *packs], pa.int32()), "_bag": pa.array([zlib.compress("\n".join(words).encode()), *(pack([v for vs in p.values() for v in vs]) for p in packs.values())], pa.binary())})
    bags = [np.array([0, 2, 5], np.uint32), np.array([], np.uint32), np.array([1, 1, 3, 4], np.uint32)]
    docs = pa.table({"doc_id": [1, 2, 3], "_chunk": [9] * 3, "_bag": pa.array([toxicity._packed(b) for b in bags], pa.binary())})
    spell, calls = toxicity._strings, []
    monkeypatch.setattr(toxicity, "_strings", lambda w: calls.append(w) or spell(w))
    got = toxicity._chunk_features(docs, sent)
    assert calls == words
    evidence = np.array([sum(value[g] for g in spell(w)) for w in words], np.float32)
    assert [[got[f][r].as_py() for f in toxicity.FEATURE_NAMES] for r in range(3)] == [toxicity.features(evidence[b]) for b in bags]
