"""Cross-tokenizer alignment against a plain version by the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from caselink.llm import alignment
from caselink.llm.alignment import byte_vocabulary, piece_model
from caselink.llm.token_counts import byte_letters


def plain(texts):
    """Rows in the order of the texts, each through whole-text encodings of the two libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(byte_vocabulary())
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    letters = byte_letters()
    docs, count = [], Counter()
    for t in texts:
        groups = []
        if t:
            a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
            ab = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
            bb = []
            for i in b:
                p = b_lib.id_to_piece(i)
                bb.append(bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode())
            if b"".join(ab) == b"".join(bb) == (" " + t).encode():
                ends = lambda x: [sum(map(len, x[: k + 1])) for k in range(len(x))]
                ea, eb = ends(ab), ends(bb)
                lo = 0
                for e in sorted(set(ea) & set(eb)):
                    groups.append(([i for i, x in zip(a, ea, strict=True) if lo < x <= e], [i for i, x in zip(b, eb, strict=True) if lo < x <= e]))
                    lo = e
        held = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        docs.append((groups, held))
        count.update(held.keys())
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for groups, held in docs:
        sha = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else ""
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(held.values()),
                    sum(n for p, n in held.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in held.items()), sha))
    return docs, out


def odd_texts():
    r = random.Random(5)
    words = ["the", "they're", "Straße", "naïve", "日本語", "😀", "don't", "<|endoftext|>", "<s>", "x" * 300, "12345", "a_b", "न", "ﬁ", "▁", "=====", "\x00", "…"]
    blanks = [" ", " ", " ", "  ", "\n", "\t", "\n\n ", " ", "\r\n", "　", "\x1c", "\x0b ", "​", " "]
    return ["".join(r.choice(words[: r.choice([4, 13, 18])]) + r.choice(blanks) * r.choice([0, 1, 1, 2]) for _ in range(r.randrange(1, 30))) for _ in range(400)]


def test_equals_whole_text_encodings(spark):
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "cat", "cat", "ab▁c", "long " * 3000, "z" * 5000, *odd_texts()]
    table = spark.createDataFrame([(i if i != 7 else None, t, "x", b"y") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, at binary").repartition(5)
    docs, want = plain(texts)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for size in (400_000, 50):  # one chunk a task, and many
        got = {r.doc_id: tuple(r[c] for c in names) for r in alignment.alignment_counts(table, byte_vocabulary(), piece_model(), size=size).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            assert got[i if i != 7 else None] == w, (i, texts[i])
    assert want[0] == want[1] == want[10] == (0, 0, 0, 0, 0, 0, "") and want[2][0] and any(w[2] < w[0] < w[3] for w in want)
    groups = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in alignment.align(table, byte_vocabulary(), piece_model()).collect()}
    assert all(groups[i if i != 7 else None] == d[0] for i, d in enumerate(docs))


def test_query_on_the_given_texts(spark):
    from conftest import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    _, want = plain([r.text for r in rows])
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.op12_cross_tokenizer_alignment(spark, DATA).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_counts(table, byte_vocabulary(), piece_model()).count() == 0
    assert alignment.align(table.withColumn("groups", F.lit(1)), byte_vocabulary(), piece_model()).count() == 0
