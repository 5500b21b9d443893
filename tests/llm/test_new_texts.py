"""Turn repair, fill-in-middle and SentencePiece against brute force, SQL and the library."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tiermem.llm import catalog, fill_middle, piece_bpe, turn_repair

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- conversation structure

GO = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repaired(rows):
    """All edits tried, by recursion, over rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def way(step, cost, letter, made, to, more=0):
            c, a, o = best(i + step, to, more)
            ways.append((c + cost, letter + a, made + o))

        for key, role in (("u", "user"), ("a", "assistant")):
            if inserted < 4 and key in GO[state]:
                way(0, 3, "I", ((role, ""),), GO[state][key], inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            way(1, 4, "D", (), state)
            if faults[i] not in ("b", "d"):
                extra = 3 if faults[i] == "t" else 0
                if role[:1] in GO[state]:
                    way(1, extra, "K", ((role, text),), GO[state][role[:1]])
                for key, new in (("u", "user"), ("a", "assistant")):
                    if key in GO[state]:
                        way(1, extra + 3, "R", ((new, text),), GO[state][key])
        return min(ways, default=(10 ** 9, "~", ()))

    cost, audit, out = best(0, 0, 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            kept += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    return out


def reports(turns):
    got = turn_repair.report(turn_repair.edited(turn_repair.damage(turns), turns)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_repair_query_equals_trying_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in catalog.QUERIES["op11_structure_repair"](spark, MIDDLE).collect()}
    assert got == {conv: repaired(turns) for conv, turns in harmed(rows).items()}


@pytest.mark.parametrize("segment", [1, 5, 4096])
def test_repair_of_odd_rows_whatever_the_segments(spark, monkeypatch, segment):
    """Nulls anywhere, ties, repeated rows, a long conversation, clashing columns; segments as short as a row."""
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    draw = random.Random(5)
    texts = ["a.", "b", "", "c!", " ", "d?\n", "e ", " f.", "\x85", "日", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = [(draw.choice([c, c, c, None]) if c < 20 else c, draw.choice([None, 0, 1, 2, 3, 5, 200]), draw.choice(roles), draw.choice(texts))
            for c in range(120) for _ in range(draw.randint(1, 7))]
    rows += [(-1, i if i % 7 else None, draw.choice(roles), draw.choice([f"x{i}.", f"y{i}", "z."])) for i in range(90)]
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, segment int, letters string, kind int")
    assert reports(wide.repartition(5)) == {conv: repaired(turns) for conv, turns in harmed(rows).items()}


def test_repair_of_equal_rows_and_whole_drops(spark):
    rows = [("k", 3, "user", "same.")] * 500 + [("k", 4, "assistant", "Yes.")] + [(f"c{i}", 0, "user", "Hi.") for i in range(60)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(4)
    want = harmed(rows)
    got = reports(turns)
    assert [] in want.values() and got.keys() == want.keys()
    for conv, kept in want.items():
        if conv == "k":
            assert got[conv][:6] == (0, 0, len(kept) - 2, 0, len(kept) - 2, 4 * (len(kept) - 2)) and set(got[conv][6]) == {"K", "D"}
        else:
            assert got[conv] == repaired(kept)
    edits = turn_repair.edited(turns.filter("conv_id = 'k'")).filter("edit is not null").collect()
    assert [(r.edit, r.fault, r.times, r.new_role) for r in edits] == [("K", None, 1, "user"), ("D", "duplicate", 499, None), ("K", None, 1, "assistant")]
    assert turn_repair.report(turn_repair.edited(turns.limit(0))).count() == 0


def test_block_tables_agree_with_single_steps():
    tables = turn_repair.Tables(turn_repair.Costs())
    draw = random.Random(1)
    for _ in range(300):
        symbols = bytes(draw.randrange(9) for _ in range(draw.randint(0, 23)))
        vector, cost = 0, tables.end_cost
        for symbol in reversed(symbols):
            vector, more = tables.step[vector][symbol]
            cost += more
        assert tables.across(symbols)[0][0] == vector and tables.cost(symbols) == cost + tables.vectors[vector][0]
    other = turn_repair.Tables(turn_repair.Costs(rerole=5, delete=2, insert=7, truncated=1))
    assert other.cost(b"") == 0 and other.cost(bytes([2, 2])) == 4 and other.cost(bytes([2, 4])) == 0


# --- fill in middle

def cut(text, key):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(drawn[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n!\r日<PSM>\U0001f600", max_size=60), st.integers())
def test_fill_in_middle_equals_cutting_lines(text, key):
    assert fill_middle.transform(text, key) == cut(text, key)
    splits = {"line": re.findall(r"[^\n]*\n|[^\n]+", text), "character": list(text), "sentence": [x for x in re.split(r"(?<=[.!?][ \t-\r])", text) if x]}
    for kind in fill_middle.KINDS:
        units = fill_middle.Units(text, kind)
        places = [units.place(k) for k in range(units.count + 1)]
        found = [text[a:b] for a, b in zip(places, places[1:])]
        assert "".join(found) == text and all(found)
        if kind != "word":
            assert found == splits[kind]
        elif text.strip():
            assert [x.strip() for x in found] == text.split()


def test_fill_in_middle_slices_agree(monkeypatch):
    text = "One line. Two\nthree!\n\nFour  five?\n" * 9 + "end"
    whole = fill_middle.classes(text)
    monkeypatch.setattr(fill_middle, "SLICE", 7)
    assert (fill_middle.classes(text) == whole).all()


def test_fill_in_middle_odd_rows(spark, odd_docs, no_docs):
    out = fill_middle.transform_texts(odd_docs)
    got = out.withColumn("whole", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == 14
    for r in got:
        assert r.whole == texts[r.doc_id]
        if r.doc_id is not None:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(texts[r.doc_id], r.doc_id)
    assert fill_middle.transform_texts(no_docs).count() == 0
    some = fill_middle.transform_texts(spark.range(400).selectExpr("cast(id as string) as doc_id", "'a\nb\nc' as text"), rate=30, spm=0)
    forms = {r[0]: r[1] for r in some.groupBy("form").count().collect()}
    assert forms.keys() == {"plain", "psm"} and 80 < forms["psm"] < 160
    with pytest.raises(ValueError):
        fill_middle.transform_texts(odd_docs, kind="page")


def test_fill_in_middle_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    columns = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    want = con.execute(f"SELECT {columns} FROM ({catalog.ORACLES['op12_fill_in_middle']}) ORDER BY 1").fetchall()
    got = catalog.QUERIES["op12_fill_in_middle"](spark, SMALL).select(*columns.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


# --- SentencePiece

@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.encoder(PIECES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aab the in  nl\n\t.▁①é梦x日", max_size=60)))
def test_pieces_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    own = piece_bpe.encoder(PIECES)
    assert own.encode(text) == own.model.encode(text, add_eos=True)


def test_pieces_of_long_and_odd_texts(pieces):
    for text in ("a" * 3000, " " * 2003, "ab" * 900, "<s></s><0x0A><unk>", "\x00a\x00", "日" * 900, "x" * 17 + " " * 33 + "the", "▁▁ ▁", "​ﬁ́"):
        assert pieces.encode(text) == pieces.model.encode(text, add_eos=True)


def test_pieces_query(spark, odd_docs, no_docs, pieces):
    got = piece_bpe.encode_texts(odd_docs, PIECES).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == 14 and piece_bpe.encode_texts(no_docs, PIECES).count() == 0
    for r in got:
        ids = pieces.model.encode(texts[r.doc_id], add_eos=True)
        assert r.ids == ids and r.decoded == pieces.model.decode(ids)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.QUERIES["op13_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = pieces.model.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(pieces.model.decode(ids).encode()).hexdigest()
