"""Chat formatting and packing."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyline.llm import chat, packing

SF = "/root/testdata/sf0.001"


@given(st.text(alphabet="\\<>[]/|INSTSYSturnend ab\n"))
def test_escape_is_reversible(text):
    import re
    hidden = chat.escape(text)
    assert re.sub(r"(?s)\\(.)", r"\1", hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, said in turns.items():
        said.sort()
        all_ = "".join(f"{r}\n{t}\n" for _, _, r, t in said)
        loss = "".join(t for _, _, r, t in said if r == "assistant")
        out[conv] = (len(said), hashlib.sha256(all_.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:5] for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got == brute(rows)


def test_digests(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])


def test_odd_turns(spark):
    check(spark, [(1, 0, None, None), (1, 0, "assistant", ""), (1, None, "user", "first"), (1, 0, "assistant", "\\"),
                  (None, 1, "assistant", "<|end|>\n\\<|turn|>"), (None, 1, "assistant", "<|end|>\n\\<|turn|>"),
                  (2, 5, "a\nb<|turn|>", "🙂" * 50), (3, 1, "assistant", "x" * 100_000)])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(empty)).count() == 0


def test_spans_come_from_prefixes():
    turns = [("user", "hi"), ("assistant", "")]
    shown, rewrites, spans = chat.locate(chat.render, turns)
    assert rewrites is None and shown == chat.render(turns)
    assert [shown[a:b] for _, _, (a, b) in spans] == ["hi", ""]
    assert spans[1][0] == (spans[0][0][1], len(shown))


def test_a_template_that_rewrites_history_is_found():
    def forgetful(turns):  # only the last assistant turn is shown
        last = max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return "".join(f"{r}:{t};" for i, (r, t) in enumerate(turns) if r != "assistant" or i == last)

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    shown, rewrites, spans = chat.locate(forgetful, turns)
    assert shown == "user:a;user:c;assistant:d;" and rewrites == 3
    assert spans[1][2] is None
    assert [shown[s[2][0]:s[2][1]] for s in spans if s[2]] == ["a", "c", "d"]


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def check_pieces(df, texts, exact):
    rows = packing.pieces(df).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for i, text in texts.items():
        mine = sorted(by_doc[i], key=lambda r: r.start)
        want = exact.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist() == want
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert {r.doc_tokens for r in mine} == {len(want)}
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, mine in by_seq.items():
        mine.sort(key=lambda r: r.offset)
        assert [r.offset for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        n = sum(r.length for r in mine)
        assert n == 2048 or s == len(by_seq) - 1
        assert {r.padded_to for r in mine} == {n if n & (n - 1) == 0 else 2048}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pieces(df)).collect()}
    assert all(whole[s] == b"".join(bytes(r.ids) for r in mine) for s, mine in by_seq.items())


def test_pieces_of_all_documents(docs, exact):
    check_pieces(docs.repartition(3, "doc_id"), dict(docs.select("doc_id", "text").collect()), exact)


def test_pieces_of_odd_documents(odd_docs, odd_texts, exact):
    check_pieces(odd_docs, dict(enumerate(odd_texts)), exact)


def test_nothing_to_pack(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a" * 9000, "\n" * 9000 + "b", "é" * 300, "  two  spaces "])
def test_both_libraries_agree(text, exact):
    assert packing.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids
