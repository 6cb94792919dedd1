"""Chat round trips, ARC to WARC, and the pipeline."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import arc, chat, layouts, warc

CONTROL = st.sampled_from(["</s>", "[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "[ROLE ", "] ", " [/ROLE]", "\\", "<", "[", "é", "\n", " "])
TEXT = st.lists(st.one_of(CONTROL, st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=5))
def test_what_is_formatted_reads_back(turns):
    formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse_turns(formatted)] == turns


@pytest.mark.parametrize(
    "record, want",
    [
        ({"messages": [{"role": "User", "content": "a"}, {"role": "assistant", "content": None}], "meta": {"x": 1}}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "r")]),
        ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
        ({"data": {"messages": [{"role": "user", "content": "a"}]}}, [("user", "a")]),
        ({"conv_id": 1, "turn": 0, "role": "Human", "text": None, "more": {"x": 1}}, [("Human", "")]),
        ({"conv_id": 1, "turn": 0, "role": "Human", "text": "a"}, [("Human", "a")]),
        ({"unknown": 1}, None),
        ({}, None),
    ],
)
def test_layouts(record, want):
    assert layouts.turns_of(record) == want


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, formatted string")


ODD = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 0, "tool] \\", "[INST] x"), (None, 0, "user", "é</s>"), (3, 0, "assistant", "\\</s>")]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("part", [chat.PART, 1])
def test_digests_of_odd_rows(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    monkeypatch.setattr(chat, "RECORD_TURNS", 64 if part > 1 else 2)
    rows = rows_of(spark, ODD)
    assert digests(chat.read_back(chat.format_turns(rows))) == expected(ODD)
    assert digests(chat.read_back(chat.format_records(chat.as_records(rows)))) == expected(ODD)
    assert digests(chat.read_back(chat.format_records(chat.as_records(rows), arranged=True), arranged=True)) == expected(ODD)
    none = rows.where("false")
    assert chat.read_back(chat.format_turns(none)).count() == 0 == chat.read_back(chat.format_records(chat.as_records(none), True), True).count()


def test_long_conversations_and_very_long_turns(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(700)] + [(2, 0, "user", "</s>[INST] " * 200_000), (2, 1, "assistant", "x" * 5_000_000)]
    rows += [(c, k, r, f"{c} {k}") for c in range(3, 60) for k, r in enumerate(["system", "user", "assistant", "user", "user", "assistant", "tool", "Human"])]
    table = rows_of(spark, rows)
    assert digests(chat.read_back(chat.format_records(chat.as_records(table), True), True)) == expected(rows)
    kinds = {layouts.fingerprint(layouts.paths_of(__import__("json").loads(r.record))) for r in chat.as_records(table).collect()}
    assert len(kinds & set(layouts.BY_FINGERPRINT)) >= 6 and kinds <= set(layouts.BY_FINGERPRINT)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "Human", "tool", ""]), st.sampled_from(["", "a", "\n\nb"])), max_size=9), st.integers(0, 40))
def test_laid_out_turns_come_back(turns, source):
    records = list(layouts.laid_out(turns, source))
    assert [t for r in records for t in layouts.turns_of(r)] == turns


def test_json_records_become_turns(spark):
    df = spark.createDataFrame([(1, '{"prompt": "p", "response": "r"}'), (2, "broken"), (3, None), (4, '{"x": 1}')], "id long, raw string")
    assert [tuple(r) for r in chat.turns_from_json(df, "id", "raw").orderBy("turn").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]


def test_a_table_of_another_layout_is_refused(spark):
    with pytest.raises(ValueError, match="fingerprint"):
        chat.format_turns(spark.createDataFrame([(1, "x")], "a int, b string"))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_conversion(version):
    content = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<html>\n\nhttp://x 1 2 3 4\n", b"", b"HTTP/1.0 200 OK\r\n\r\n", b"plain\r\n\r\nWARC/1.1"]
    given_ = [arc.ArcRecord(f"http://h/{i} q", "1.2.3.4", "20010203040506", "text/html", c, {}) for i, c in enumerate(content)]
    data = arc.write_arc("t.arc", given_, version)
    back = list(arc.read_arc(data))
    assert [r.content for r in back] == content and back[0].url == "http://h/0%20q" and back[0].fields["Archive-length"] == str(len(content[0]))
    archive = b"\r\n\r\n".join(arc.to_warc(r) for r in back) + b"\r\n\r\n"
    got = list(arc.read_warc(archive))
    assert [b for _, b in got] == content and [f["warc-type"] for f, _ in got] == ["response", "resource", "response", "resource"]
    assert got[0][0]["warc-date"] == "2001-02-03T04:05:06Z" and got[0][0]["warc-payload-digest"] == "sha1:" + arc.sha1(b"<html>\n\nhttp://x 1 2 3 4\n")
    assert len({f["warc-record-id"] for f, _ in got}) == 4 and got == list(arc.read_warc(archive))


@pytest.mark.parametrize("data", [b"", b"no version block\n", b"filedesc://x 0.0.0.0 1 text/plain 4\n9 0\n", arc.write_arc("t", [arc.ArcRecord("u", "i", "2001", "t", b"abc", {})], 1)[:-3]])
def test_broken_archives_raise(data):
    with pytest.raises((ValueError, IndexError)):
        list(arc.read_arc(data))


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, first string, sha1 int")


def test_no_record_ends_a_task(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = [
        (1, '{"messages": [{"role": 7, "content": "a"}, {"role": true, "content": 3}, {"role": null, "content": null}, "x", 4]}'),
        (2, '{"messages": [{"role": "user", "content": "half \\ud83d of a pair, and a whole \\ud83d\\ude00"}]}'),
        (3, '{"messages": ' + deep + "}"), (4, '{"prompt": ' + '{"a":' * 5000 + "1" + "}" * 5000 + ', "response": "r"}'),
        (5, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image", "url": "u"}, {"type": "text", "text": "here"}]}, {"role": "gpt", "content": "plain"}]}'),
        (6, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "parts alone"}]}]}'),
        (7, '{"messages": {"role": "user", "content": "no list"}}'), (8, '{"prompt": ["a", "b"], "response": {"x": 1}}'), (9, "{broken"), (10, None), (11, "[1]"), (12, '{"prompt": 1e400, "response": ' + "9" * 5000 + "}"),
    ]
    df = spark.createDataFrame([(i, 0, r) for i, r in records], "conv_id long, ord long, record string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.read_back(chat.format_records(df)).collect()}
    said = {}
    for r in chat.turns_from_json(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    assert said[1] == [("7", "a"), ("true", "3"), ("", "")] and said[2] == [("user", "half \ufffd of a pair, and a whole \U0001f600")]
    assert said[5] == [("user", "look\n\nhere"), ("assistant", "plain")] and said[6] == [("user", "parts alone")]
    assert set(said) == set(got) == {1, 2, 5, 6} and got[5][0] == 2


def test_archives_read_back(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "a b\nc", None), (5, "v", ""), (4, "w", "é\r\n\r\nWARC/1.1\r\n"), (1, None, "same"), (None, "n", "same")]
    got = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages_of(spark, rows)).collect())
    assert got == [(-1, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 0, "response", None), (3, 4, "revisit", 1), (4, 16, "response", None), (5, 0, "revisit", 2)]
    assert warc.archived(pages_of(spark, rows).where("false")).count() == 0


def test_small_payloads_are_all_responses_and_references_resolve(spark):
    from strandline.llm.common import new_path

    path = new_path(spark, "warc-test")
    warc.write(pages_of(spark, [(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abcd"), (4, "x", "abcd")]), path, least=3)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert [got[i].record_type for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    import gzip

    fields = {f["warc-record-id"]: f for x in files for f, _ in arc.read_warc(gzip.decompress(bytes(x.content)))}
    assert fields[got[4].record_id]["warc-refers-to"] == got[3].record_id


def test_files_are_bounded_by_bytes_and_seekable_with_unique_ids(spark, monkeypatch):
    import gzip
    import zlib

    from strandline.llm.common import new_path

    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "ARC_BYTES", 5_000)
    rows = [(i, f"u{i}", f"{i} " * (3_000 if i % 7 == 0 else 40)) for i in range(60)] + [(3, "u3", "3 " * 40)] * 5 + [(None, "n", "3 " * 40)] * 3 + [(99, "big", "x" * 300_000)]
    path = new_path(spark, "warc-test")
    warc.write(pages_of(spark, rows).repartition(3), path)
    files = [bytes(x.content) for x in spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).collect()]
    assert len(files) > 5
    ids, refers = [], []
    for data in files:
        whole, at, kinds = list(arc.read_warc(gzip.decompress(data))), 0, []
        data = data.rstrip(b"\0") + b"\0\0\0\0"  # a member ends with the size, whose upper bytes may be zero
        while data[at : at + 2] == b"\x1f\x8b":  # every member is one record
            z = zlib.decompressobj(31)
            (fields, _),  = arc.read_warc(z.decompress(data[at:]))
            kinds.append(fields["warc-type"])
            at = len(data) - len(z.unused_data)
            ids.append(fields["warc-record-id"])
            refers += [fields["warc-refers-to"]] if "warc-refers-to" in fields else []
        assert len(kinds) == len(whole) and kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        assert sum(len(b) for _, b in whole) < 30_000 or len(whole) == 2
    assert len(ids) == len(set(ids)) == len(rows) + len(files) and len(refers) == 3 and set(refers) <= set(ids)
    assert warc.read(spark, path).count() == len(rows)
