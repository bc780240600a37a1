"""Round trips through wrong encodings, names that only look garbled, and edge cases."""

import pytest

from tallyforge.llm.encoding_repair import garbled_names, garbled_texts, restore, restored_headers

GIVEN = ["Klaßördreas", "Тевлан Растев.bin", "ラサ空ベルカ (Demo).bin", "Ελαλδρα (Disc 2)", "“Seax” Baind.cue", "Naisøaçl Klealtfind"]
WRONG = [("utf-8", "cp437"), ("utf-8", "cp1252"), ("cp932", "cp437"), ("cp1251", "cp437"), ("cp1251", "cp1252"), ("cp1252", "cp437")]


def lenient(raw, codec):
    return "".join(bytes([b]).decode(codec) if bytes([b]).decode(codec, "ignore") else chr(b) for b in raw)


@pytest.mark.parametrize("name", GIVEN)
@pytest.mark.parametrize("written,read", WRONG)
def test_one_wrong_reading_is_undone(name, written, read):
    try:
        raw = name.encode(written)
    except UnicodeEncodeError:
        pytest.skip("can't be written so")
    seen = lenient(raw, read)
    if written == "cp932" and name[0] == "“":  # reads as letters that a name may have, and so is taken as sound
        assert restore(seen) == (seen, False)
    else:
        assert restore(seen) == (name, seen != name)


def test_several_wrong_readings():
    name = "Stîoónpraix"
    once = lenient(name.encode(), "cp1252")
    twice = lenient(once.encode(), "cp1252")
    assert restore(twice) == (name, True)
    assert restore(lenient(lenient(twice.encode(), "cp1252").encode(), "cp1252")) == (name, True)  # four edges, as many as DEPTH says


def test_escapes():
    assert restore("Caf&eacute; &amp; Bar") == ("Café & Bar", True)
    assert restore("%D0%A0%D0%BE%D0%B2") == ("Ров", True)
    assert restore("caf\\u00e9") == ("café", True)


@pytest.mark.parametrize("name", ["", "plain.bin", "100% (Demo)", "Shio ╔═╗ 6", "░▒▓ Kisbund ▓▒░", "Bakeark ±0° 5", "Flaingros £1", "Beapiork ½", "VILÃO Shunbrirk", "GARÇNAILTÃ.cue", "ÅSGRANDHOUÖ 11", "Σ Zaperk", "Lalflu № 7", "Klaindnet™ Cursor", "Maltklix’s Durktri", "Prolium… Nioltfot", "Тевгове", "かゴルカカめ", "Νόελζη Keand", "Dîruboöm"])
def test_sound_names_stay(name):
    assert restore(name) == (name, False)


def test_lost_characters_are_garbled_and_come_back_from_bytes():
    assert restore("Dral�pi") == (None, True)
    assert restore("Dral�pi", "Dralépi".encode("cp437")) == ("Dralépi", True)


def test_very_long_text_is_searched_whole():
    text = "Räiovim " * 5_000
    assert restore(lenient(text.encode(), "cp1252")) == (text, True)


def test_tables(spark):
    df = spark.createDataFrame([(1, "NanÃ´d", "x"), (1, "NanÃ´d", "y"), (2, None, None), (3, "", None), (4, "plain", None), (None, "Kal├®b", None), (5, "Dral�", None)], "header_id bigint, filename string, given string")
    assert {tuple(r) for r in garbled_texts(df, "filename", "header_id").collect()} == {(1, "NanÃ´d", "Nanôd"), (None, "Kal├®b", "Kaléb"), (5, "Dral�", None)}
    assert garbled_texts(df.limit(0), "filename", "header_id").count() == 0
    raw = spark.createDataFrame([(1, bytearray("Klaß".encode()), 0), (2, bytearray("Klaß".encode()), 2048), (3, bytearray("Drñb".encode("cp437")), 2048), (4, None, 0), (5, bytearray(b""), None)], "entry_id bigint, b binary, flags int")
    assert {(r.row_id, r.given) for r in garbled_names(raw, "b", "flags", "entry_id").collect()} == {(1, "Klaß"), (3, "Drñb")}


def test_lost_header_is_restored_from_its_entry(spark):
    headers = spark.createDataFrame([(1, 7, 0, "Dr�b.bin"), (2, 7, 1, "Dr�b.bin")], "header_id bigint, archive_id bigint, entry_index int, filename string")
    entries = spark.createDataFrame([(9, 7, 0, bytearray("Drñb.bin".encode("cp437")), 2048)], "entry_id bigint, archive_id bigint, entry_index int, filename_bytes binary, flags int")
    assert {(r.row_id, r.given) for r in restored_headers(headers, entries).collect()} == {(1, "Drñb.bin"), (2, None)}


def test_every_tied_entry_can_restore_a_lost_header(spark):
    headers = spark.createDataFrame([(i, 7, i, f"L�st{i}.bin") for i in range(1, 6)], "header_id bigint, archive_id bigint, entry_index int, filename string")
    sound, garbled, gone = "Lóst{}.bin".encode, "Lóst{}.bin".encode("cp437"), "L�st{}.bin".encode()
    raw = [(1, sound(), 2048), (2, gone, 2048), (2, garbled, 2048), (3, garbled, 2048), (3, gone, 2048), (4, b"plain.bin", 0), (5, gone, 2048), (5, None, 0)]
    entries = spark.createDataFrame([(i, 7, e, None if b is None else bytearray(b), f) for i, (e, b, f) in enumerate(raw)], "entry_id bigint, archive_id bigint, entry_index int, filename_bytes binary, flags int")
    assert {r.row_id: r.given for r in restored_headers(headers, entries).collect()} == {1: "Lóst{}.bin", 2: "Lóst{}.bin", 3: "Lóst{}.bin", 4: "plain.bin", 5: None}


def test_names_of_a_made_corpus_come_back(spark):
    """Known names through known wrong readings, as header text and as entry bytes: the name given, not only the flag."""
    names = [f"{a}{i} {b}" for i, (a, b) in enumerate((a, b) for a in ("Klaßör", "Тевлан", "ラサ空", "Ελαλδρα", "Naïvø") for b in ("(Demo).bin", "Disc", "Größe.cue"))]
    headers, entries, want = [], [], set()
    for i, n in enumerate(names):
        seen = lenient(n.encode(), "cp437")
        headers.append((i, 1, i, seen))
        entries.append((100 + i, 1, i, bytearray(n.encode()), 0))  # stored in UTF-8, read without the flag
        want.add(("h", i, n))
        want.add(("e", 100 + i, n))
    h = spark.createDataFrame(headers, "header_id bigint, archive_id bigint, entry_index int, filename string")
    e = spark.createDataFrame(entries, "entry_id bigint, archive_id bigint, entry_index int, filename_bytes binary, flags int")
    got = {("h", r.row_id, r.given) for r in restored_headers(h, e).collect()} | {("e", r.row_id, r.given) for r in garbled_names(e, "filename_bytes", "flags", "entry_id").collect()}
    assert got == want
