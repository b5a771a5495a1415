"""Personal data, token files, byte-level BPE: against plain versions, and the cases at the edges."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from haplospan.llm import bpe, huffman, pii, queries
from haplospan.llm.tokens import WordEncoder, byte_letters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, ids string"
ODD = [
    (1, None, "en", "a", 0, "x", "y"),
    (2, "", "en", "a", 0, "x", "y"),
    (3, "a.b@c.de and 1.2.3.4, 4111 1111 1111 1111 +1 (702) 555-0742", "en", "a", 0, "x", "y"),
    (3, "a.b@c.de and 1.2.3.4, 4111 1111 1111 1111 +1 (702) 555-0742", "en", "a", 0, "x", "y"),
    (None, "no id", None, None, None, None, None),
    (4, "x" * 100_000, "en", "a", 0, "x", "y"),
    (5, "  two  spaces \n\n<|endoftext|> tail ", "en", "a", 0, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base(t):
    return [(pii.KINDS[k], a, b) for k, a, b in pii.spans_of(t) if k < 4]


def test_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@@1234567890+-() .%_") for _ in range(rng.randint(1, 60)))
        assert base(t) == plain_spans(t), t


def test_added_kinds_and_masks():
    t = 'pay DE89370400440532013000 token = "186661156f3f9905942d" see https://u.example/x?y now'
    assert [pii.KINDS[k] for k, _, _ in pii.spans_of(t)] == ["account", "secret", "url"]
    assert pii.masked("to a@b.cd or 1.2.3.4") == "to [EMAIL] or [IP]"
    assert pii.masked(None) is None and pii.masked("") == ""


def test_schemes_of_any_length():
    scheme = "a" + "b+c-1." * 50_000
    assert [(k, a, b) for k, a, b in pii.spans_of(f"see 9{scheme}://host/x now") if k == 6] == [(6, 5, 5 + len(scheme) + 9)]
    assert not [s for s in pii.spans_of("123://host/x") if s[0] == 6]


def test_personal_data_query(spark, odd):
    rows = {r["doc_id"]: r for r in pii.digests(pii.find_personal_data(odd)).collect()}
    assert len(rows) == 6 and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (rows[3]["n_email"], rows[3]["n_ip"], rows[3]["n_card"], rows[3]["n_phone"]) == (1, 1, 1, 1)
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(ODD[2][1]))
    assert rows[3]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and rows[3]["spans"] == want
    assert pii.find_personal_data(odd.limit(0)).count() == 0
    assert pii.mask_personal_data(odd).columns == odd.columns and pii.mask_personal_data(odd).count() == 7


@pytest.fixture(scope="module")
def tik():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, odd, tik):
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghij ABC  \n\t'0123_-=.,éß漢🙂‍") for _ in range(rng.randint(1, 200))) for _ in range(2000)]
    texts += ["a" * 20_000, " " * 3000 + "x", "-" * 3000, "ab" * 3000]
    texts += [" ".join("".join(rng.choice("aeiourstlnhdcmt") for _ in range(rng.randint(2, 12))) for _ in range(300)) for _ in range(200)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, codec.kind).tolist() == tik.encode_ordinary(t)
    assert [codec.encode([t])[0] for t in texts] == codec.encode(texts)
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.decode_documents(bpe.encode_documents(odd, path, P.PATTERN), path).collect()
    assert rows == bpe.round_trip(odd, path, P.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    assert bpe.digests(odd.limit(0), path, P.PATTERN).count() == 0


def test_bpe_forgets_only_what_is_rare(monkeypatch, tik):
    monkeypatch.setattr(bpe, "PIECES", 50)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    codec = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(7)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcdenrst") for _ in range(rng.randint(1, 6))) for _ in range(40))
        assert np.frombuffer(codec.encode([t])[0], codec.kind).tolist() == tik.encode_ordinary(t)
    assert len(codec.young) + len(codec.old) <= 200


def test_bpe_query(spark, tik):
    got = {r["doc_id"]: r for r in queries.op10_byte_bpe(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tik.encode_ordinary(d["text"] or "")
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
        assert got[d["doc_id"]]["n_tokens"] == len(ids)


def test_words_equal_whole_texts():
    w = WordEncoder(P.path("byte_bpe_50k.json"))
    assert w.by_word
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab'st1 \n\t\x1c\x85\u00a0é漢.\0-") for _ in range(rng.randint(0, 25))) for _ in range(20_000)] + ["<|endoftext|> a\n<|endoftext|>"]
    assert w.encode(texts) == [w.whole(t) if t else b"" for t in texts]


def library_rows(docs, end=2):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = library_rows(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(map(tuple, queries.op2_token_files(spark, SF).collect())) == want
    order = sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    marks = [(10, "a <|endoftext|> b"), (11, "<|endoftext|>"), (12, "x<|endoftext|>\ny <|endoftext|><|endoftext|>")]
    assert library_rows(marks)[0][2] == 5
    marked = spark.createDataFrame(marks, "doc_id long, text string")
    assert sorted(map(tuple, huffman.ids_from_files(marked, P.path("byte_bpe_50k.json"), 2).collect())) == library_rows(marks)
    got = huffman.ids_from_files(odd, P.path("byte_bpe_50k.json"), 2).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == library_rows(order)
    assert huffman.ids_from_files(odd.limit(0), P.path("byte_bpe_50k.json"), 2).count() == 0


def test_huffman_round_trip():
    rng = np.random.default_rng(4)
    for symbols in (1, 2, 3, 700, 50_000):
        ids = np.minimum(rng.zipf(1.3, 20_000), symbols) - 1
        counts = dict(enumerate(np.bincount(ids).tolist()))
        code = huffman.code_lengths(counts)
        assert max(code.values()) <= huffman.MAX_BITS and sum(2.0 ** -b for b in code.values()) <= 1
        a, b, c = huffman.canonical(*np.array(sorted(code.items())).T)
        bits, codes = np.zeros(a.max() + 1, dtype=np.int64), np.zeros(a.max() + 1, dtype=np.int64)
        bits[a], codes[a] = b, c
        payload, points = huffman.pack(ids, bits, codes)
        symbol, width = np.repeat(a, 1 << (huffman.MAX_BITS - b)), np.repeat(b, 1 << (huffman.MAX_BITS - b))
        gap = (1 << huffman.MAX_BITS) - len(symbol)
        symbol, width = np.pad(symbol, (0, gap)).astype(np.uint32), np.pad(width, (0, gap), constant_values=1).astype(np.uint32)
        assert (huffman.unpack(payload, points, len(ids), symbol, width) == ids).all()


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    rng = random.Random(5)
    for _ in range(30):
        counts = {k: rng.randint(1, 50) for k in range(rng.randint(2, 40))}
        heap = [(n, k, 0) for k, n in counts.items()]
        heapq.heapify(heap)
        total, mark = 0, 1000
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], mark, 0))
            mark += 1
        assert sum(counts[k] * b for k, b in huffman.code_lengths(counts).items()) == total


def test_words_of_letters_and_marks_pass_no_search_for_pieces(tmp_path):
    """Letters and the marks after them go to the model alone; all words have the ids that the library gives the text."""
    path = P.path("byte_bpe_50k.json")
    library, encoder, searched = Tokenizer.from_file(path), WordEncoder(path), []
    whole = encoder.whole
    encoder.whole = lambda text: searched.append(text) or whole(text)
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdeÀßéÿŁTR") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "!!", "'", "%%%", ").", '"']) for _ in range(4_000)]
    texts = [(" " if k % 3 else "\n").join(plain[k : k + 40]) for k in range(0, 4_000, 40)]
    packed = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert encoder.encode(texts) == packed and encoder.encode(texts) == packed
    assert not [t for t in searched if any(c.isalpha() for c in t)]
    odd = ["".join(rng.choice("ab'sT1²ªµ×÷ƒɐяд中٣\u0301\x1c\u200b.,_-~é ") for _ in range(rng.randint(1, 60))) for _ in range(4_000)]
    assert encoder.encode(odd) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in odd]
    library.enable_truncation(3)
    library.save(str(tmp_path / "short.json"))
    assert WordEncoder(str(tmp_path / "short.json")).encode(["some words, more words"]) == [np.array(library.encode("some words, more words").ids, dtype="<u2").tobytes()]


class Calls:
    """A tokenizer that counts the calls it gets."""

    def __init__(self, inner):
        self.inner, self.count = inner, 0

    def encode_batch_fast(self, *a, **b):
        self.count += 1
        return self.inner.encode_batch_fast(*a, **b)


def test_new_words_share_calls_of_the_model():
    """20,000 new words take some dozen calls of the library, and none when they come again; ids are the library's."""
    encoder, rng = WordEncoder(P.path("byte_bpe_50k.json")), random.Random(8)
    library = encoder.library
    words = list({"".join(rng.choice("abcdeÀßéÿŁTR") for _ in range(rng.randint(5, 12))) for _ in range(20_000)})
    texts = [("\n" if k % 3 == 0 else " ").join(w + rng.choice(["", "", ",", "!!"]) for w in words[k : k + 40]) for k in range(0, len(words), 40)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    encoder.library, encoder.model = Calls(library), Calls(encoder.model)
    assert encoder.encode(texts) == want
    assert encoder.library.count + encoder.model.count < 60
    before = encoder.model.count
    assert encoder.encode(texts[::-1]) == want[::-1] and encoder.model.count == before


@pytest.mark.parametrize(
    "odd",
    [
        {},
        {"merges": [("a", "Ġ"), ("b", "c"), ("aĠ", "bc")]},  # over the space
        {"merges": [("a", "Ċ"), ("Ċ", "b")]},  # over the line feed
        {"ignore_merges": True, "more": ["Ġabc", "abc"]},
        {"end_of_word_suffix": "</w>", "more": [f"{x}</w>" for x in byte_letters().values()], "merges": [("b", "c</w>")]},
        {"added": ["bca", "Ġ"]},
        {"more": [f"word{k}" for k in range(70_000)]},  # ids of 32 bits
    ],
)
def test_words_of_other_vocabularies(tmp_path, odd):
    from tokenizers import models, pre_tokenizers

    merges = [("a", "b"), ("Ġ", "a"), ("Ġa", "b"), *odd.get("merges", ())]
    names = dict.fromkeys([*byte_letters().values(), *odd.get("more", ()), *("".join(m) for m in merges)])
    kind = models.BPE(vocab={t: k for k, t in enumerate(names)}, merges=merges, **{k: v for k, v in odd.items() if k in ("ignore_merges", "end_of_word_suffix")})
    library = Tokenizer(kind)
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.add_tokens(odd.get("added", []))
    library.save(str(tmp_path / "t.json"))
    encoder, rng = WordEncoder(str(tmp_path / "t.json")), random.Random(9)
    texts = ["".join(rng.choice("aabbcc  \n,é1") for _ in range(rng.randint(0, 30))) for _ in range(2_000)]
    assert encoder.by_word
    assert encoder.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype=encoder.kind).tobytes() for t in texts]


def test_texts_go_by_bounded_bytes(spark, monkeypatch):
    """Rows keep their order and ids however few bytes are encoded at a time."""
    texts = [None, "", "a b", "  two  spaces", "line\nline", "x" * 50, "漢字 かな", "a\x1cb \x85", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = library_rows(list(enumerate(texts)))
    for size in (1, 7, 1 << 22):
        monkeypatch.setattr(huffman, "TEXT_BYTES", size)
        assert sorted(map(tuple, huffman.ids_from_files(docs, P.path("byte_bpe_50k.json"), 2).collect())) == want


def test_codes_are_packed_most_significant_bit_first():
    """Payloads equal the codes written one after the other, for ids of more than 24 bits as well; few sums are made for a block."""
    rng = np.random.default_rng(6)
    for n, last in ((0, 5), (1, 5), (40, 2), (5_000, 40_000), (5_000, 1 << 25)):
        ids = np.minimum(rng.zipf(1.2, n), 40_000) - 1
        ids[ids == ids.max(initial=0)] = last
        counts = {0: 1, 1: 1} | {int(k): int(c) for k, c in zip(*np.unique(ids, return_counts=True), strict=True)}
        a, b, c = huffman.canonical(*np.array(sorted(huffman.code_lengths(counts).items())).T)
        bits, codes = np.zeros(a.max() + 1, dtype=np.int64), np.zeros(a.max() + 1, dtype=np.int64)
        bits[a], codes[a] = b, c
        text = "".join(f"{codes[i]:0{bits[i]}b}" for i in ids)
        payload, points = huffman.pack(ids, bits, codes)
        assert payload == bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))
        joined = huffman.look_up(a, b)
        assert joined.dtype == (np.uint64 if a.max() >= 1 << 24 else np.uint32)
        assert (huffman.unpack_joined(payload, points, n, joined) == ids).all()
