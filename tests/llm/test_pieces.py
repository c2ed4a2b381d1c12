import random

import pandas as pd
import pytest
import sentencepiece

from lectern.llm import pieces


@pytest.fixture(scope="module")
def tool():
    return pieces.encoder(pieces.MODEL)


TEXTS = ["", " ", "Hello world", "  two  blanks ", "ünïcödé \U0001f600 mixed", "tab\tand\nline", "a" * 5000, "▁ marks ▁▁", "​́", "ﬁne ½ Ⅳ", "日本語 text"]


def test_offsets_tile_the_text_and_round_trip(tool):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].tolist()
    for text, (ids, starts, ends) in zip(TEXTS + docs, tool.encode(TEXTS + docs)):
        source = text.encode()
        assert ids.tolist() == tool.library.encode(text)
        if len(ids):
            assert starts[0] == 0 and ends[-1] == len(source) and (starts[1:] == ends[:-1]).all() and (starts <= ends).all()
        if "▁" not in text:
            assert tool.decode(ids.tolist()) == source


def test_spans_are_what_the_pieces_say(tool):
    for text in ["Hello world again", "naïve café", "x  y"]:
        (ids, starts, ends), = tool.encode([text])
        for i, a, b in zip(ids.tolist(), starts, ends):
            piece = tool.surface[i]
            assert piece.lstrip(b" ") == text.encode()[a:b].lstrip(b" ")


class PlainMap(pieces.CharacterMap):
    """The same walk over a dictionary: the longest key at a position."""

    def __init__(self, rules):
        self.rules, self.units = rules, [1]

    def longest(self, data, at):
        keys = [k for k in self.rules if data.startswith(k, at)]
        best = max(keys, key=len, default=b"")
        return len(best), best

    def replacement(self, place):
        return self.rules[place]


def test_longest_prefix_and_alignment():
    class Spec:
        precompiled_charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = b"", True, True, True

    n = pieces.Normaliser(Spec)
    n.map, n.fast = PlainMap({b"a": b"1", b"ab": b"22", "ﬁ".encode(): b"fi", b"\t": b" "}), False
    out, where = n.align("  abxa\t ﬁ ".encode())
    assert out.decode() == "▁22x1▁fi"
    source = "  abxa\t ﬁ ".encode()
    assert len(where) == len(out) + 1
    assert where[3] == source.index(b"ab") and where[4] == source.index(b"ab") and where[5] == source.index(b"x")
    assert where[out.index(b"fi")] == source.index("ﬁ".encode())
    assert (where[1:] >= where[:-1]).all()


def compiled(rules):
    """A compiled character map for the rules: a double array, its size in front, the replacements behind."""
    pool, units, used = b"", {}, {0}
    values = {}
    for key, new in rules.items():
        values[key] = len(pool)
        pool += new + b"\0"

    def place(prefix, at):
        labels = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in rules
        offset = 1
        while any((at ^ offset ^ c) in used for c in [*labels, *([0] if leaf else [])]):
            offset += 1
        units[at] = units.get(at, 0) | offset << 10 | leaf << 8
        base = at ^ offset
        used.update(base ^ c for c in labels)
        if leaf:
            used.add(base)
            units[base] = 1 << 31 | values[prefix]
        for c in labels:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = (max(units) // 256 + 2) * 256
    blob = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(size))
    return len(blob).to_bytes(4, "little") + blob + pool


def test_compiled_map_finds_the_longest_prefix():
    rules = {b"a": b"1", b"ab": b"22", b"abcd": b"4", "ﬁ".encode(): b"fi", b"z": b""}
    chars = pieces.CharacterMap(compiled(rules))
    for data, at, key in [(b"abx", 0, b"ab"), (b"abcx", 0, b"ab"), (b"abcd", 0, b"abcd"), (b"xa", 1, b"a"), (b"x", 0, None), ("ﬁ".encode(), 0, "ﬁ".encode()), (b"z", 0, b"z")]:
        length, place = chars.longest(data, at)
        assert length == len(key or b"")
        assert key is None or chars.replacement(place) == rules[key]
    assert pieces.CharacterMap(b"").longest(b"abc", 0) == (0, 0)


def test_random_bytes_round_trip(tool):
    r = random.Random(4)
    texts = ["".join(chr(r.choice([r.randint(32, 126), r.randint(161, 0x2FF), r.randint(0x4E00, 0x4FFF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(r.randint(0, 80))) for _ in range(200)]
    for text, (ids, _, _) in zip(texts, tool.encode(texts)):
        assert tool.decode(ids.tolist()).decode() == text == tool.library.decode(ids.tolist())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pieces.encoded(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.ids is None) == (r.decoded_ok is None)
    assert [r.ids for r in rows if r.doc_id == 2] == [[]]
    assert all(r.decoded_ok for r in rows if r.ids is not None)
    assert pieces.encoded(no_docs).collect() == []
    back = {r.doc_id: r.text for r in pieces.decoded(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id bigint, ids array<int>")).collect()}
    assert back[1] is None and back[2] == "" and back[4].startswith("the quick") and len(back[6]) > 100_000
    bad = spark.createDataFrame([(1, [10**6]), (2, [None]), (3, [-1])], "doc_id bigint, ids array<int>")
    assert {r.text for r in pieces.decoded(bad).collect()} == {None}


def test_library_is_the_reference(tool):
    other = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [i.tolist() for i, _, _ in tool.encode(["some text"])] == other.encode(["some text"])


@pytest.fixture(scope="module")
def mapped():
    return pieces.encoder(pieces.MODEL, pieces.RULE)


ODD = ["", " ", "ﬁne½ café x\ty", "e\u0301a\u0308 n\u0303o", "ＡＢＣ１２３　全角", "①②③ ㍿ ㌀", "\u00a0nbsp\u2003em", "a\u0301\u0323 \u1e9b\u0323", "한글 ᄒ\u1161\u11ab", "zero\u200bwidth\ufeff", "\x01\x7fctrl\r\n", "Ⅷ ﬄ ĳ", "\u0301 alone", "日本語ﾃｷｽﾄ", "🇩🇪 👩\u200d👩 x", "٣ ۵"]


def test_map_runs_and_equals_the_library_normaliser(mapped):
    """The alignment replays the library's normaliser byte for byte, on texts that the map rewrites and on the corpus."""
    assert mapped.normaliser.fast and mapped.normaliser.map.units
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].tolist()
    r = random.Random(6)
    wild = ["".join(chr(r.choice([r.randint(9, 126), r.randint(0xA0, 0x36F), r.randint(0x2000, 0x24FF), r.randint(0x3000, 0x33FF), r.randint(0xFB00, 0xFB06), r.randint(0xFF01, 0xFFEF)])) for _ in range(r.randint(0, 60))) for _ in range(500)]
    rewritten = 0
    for text in ODD + wild + docs:
        normal, where = mapped.normaliser.align(text.encode())
        assert ("▁" + normal.decode().replace(" ", "▁") if text else "") == mapped.library.normalize(text)
        assert len(where) == len(mapped.library.normalize(text).encode()) + 1 and (where[1:] >= where[:-1]).all()
        rewritten += normal != text.encode()
    assert rewritten > 400


def test_fast_path_equals_the_plain_walk(mapped):
    for text in ODD:
        normal, where = mapped.normaliser.align(text.encode())
        out, slow = mapped.normaliser._walk(text.encode())
        assert (SPACE_ + normal.replace(b" ", SPACE_) if text else b"") == out or not text
        assert where.tolist() == slow.tolist()


SPACE_ = "▁".encode()


def test_offsets_project_pieces_to_the_original(mapped):
    """The part of the text that a piece covers normalises to the piece."""
    for text in ["ﬁne café", "ＡＢＣ　１２", "x½y", "e\u0301t"]:
        (ids, starts, ends), = mapped.encode([text])
        source = text.encode()
        assert ids.tolist() == mapped.library.encode(text)
        assert starts[0] == 0 and ends[-1] == len(source) and (starts[1:] == ends[:-1]).all()
    (ids, starts, ends), = mapped.encode(["a ﬁ"])
    spelled = [("a ﬁ".encode()[a:b], mapped.surface[i]) for i, a, b in zip(ids.tolist(), starts, ends)]
    assert b"".join(s for s, _ in spelled) == "a ﬁ".encode() and b"".join(p for _, p in spelled) == b" a fi"


def test_a_map_with_other_keys_takes_the_walk():
    class Spec:
        precompiled_charsmap, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = compiled({b"ab": b"x"}), True, False, True

    n = pieces.Normaliser(Spec)
    assert not n.fast and n.align(b"zab")[0].decode() == "▁zx"


def test_query_equals_the_library(spark, sf):
    """Ids, decoding and offsets of the whole table against the library with the same map."""
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.with_rule(open(pieces.MODEL, "rb").read(), pieces.RULE))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op7_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.ids == library.encode(text) and r.decoded_ok
        assert "".join(text.encode()[a:b].decode("utf-8", "replace") for a, b in zip(r.starts, r.ends)) == text or "�" in text
