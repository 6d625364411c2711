"""Problems 2, 4, 6, 7 and 10."""

import pytest
from pyspark.sql import Row

from inkgraph.llm import mojibake, pii, scans, sentences, turns


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("", []), (" \n ", []), (None, []),
        ("Dr. Lee came at 8:14 a.m. from No. 3. He left.", ["Dr. Lee came at 8:14 a.m. from No. 3.", "He left."]),
        ("SCENE LOG\n\nIt rained… or so. “Get out!” Dr. Ray shouted from the yard. “Who?” asked R/O Lee. He said, “Never. I swear.” Then left", ["SCENE LOG", "It rained… or so.", "“Get out!” Dr. Ray shouted from the yard.", "“Who?” asked R/O Lee.", "He said, “Never. I swear.”", "Then left"]),
        ("“我不知道。”司徒说。窗户碎了……但没有血迹。温度为3.5度！", ["“我不知道。”司徒说。", "窗户碎了……但没有血迹。", "温度为3.5度！"]),
        ("「本当です。」と彼は答えた。雨だ。", ["「本当です。」と彼は答えた。", "雨だ。"]),
        ("Der Zeuge schwieg z. T. minutenlang. Am 3. Oktober kam Fr. Lang.", ["Der Zeuge schwieg z. T. minutenlang.", "Am 3. Oktober kam Fr. Lang."]),
        ("Сосед услышал шум около 9 ч. ночи. Нашли перчатку и т. п. Никто не спорил!", ["Сосед услышал шум около 9 ч. ночи.", "Нашли перчатку и т. п.", "Никто не спорил!"]),
        ("قال د. سالم إن الغرفة باردة. من أغلق الباب؟", ["قال د. سالم إن الغرفة باردة.", "من أغلق الباب؟"]),
        ("ประตูหลังบ้านถูกล็อก ธารเวล มณีกรกลับถึงบ้านตอนดึก", ["ประตูหลังบ้านถูกล็อก", "ธารเวล มณีกรกลับถึงบ้านตอนดึก"]),
        ("दरवाज़ा बंद था। डॉ. मृगेला ने लिखा।", ["दरवाज़ा बंद था।", "डॉ. मृगेला ने लिखा।"]),
    ],
)
def test_sentence_units(text, units):
    at, got = 0, []
    for e in sentences.sentence_ends(text):
        got.append(text[at:e].strip())
        at = e
    assert got == units


def test_items_that_carry_on(spark):
    items = ["Ann came. Mr.", None, " ", "Lee left with a B.A.", "in drafting. End."]
    assert sentences.item_ends(items) == [(0, 9), (4, 12), (4, 17)]
    assert sentences.item_ends([]) == [] and sentences.item_ends([None]) == []
    n = spark.createDataFrame([(1, "typed", "One. Two."), (2, "scan", "No."), (3, None, "Three."), (4, "typed", None)], "id bigint, intake string, text string")
    b = spark.createDataFrame([(1, None), (2, [Row(text="A b.", has_time=False), None])], "id bigint, sentences array<struct<text:string,has_time:boolean>>")
    got = {tuple(r) for r in sentences.find(n, b).collect()}
    assert got == {("narratives", 1, 0, 4), ("narratives", 1, 0, 9), ("narratives", 3, 0, 6), ("victim_biographies", 2, 0, 4)}
    long = "A b. " * 20_000
    assert len(sentences.sentence_ends(long)) == 20_000


def test_every_terminator_ends_a_sentence():
    import regex

    marks = regex.findall(r"\p{Sentence_Break=STerm}", "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)])))
    assert len(marks) > 140 and "\u17d4" in sentences.STOPS + "\u17d4"
    for c in marks:
        assert sentences.sentence_ends(f"Abc{c} Def") == [4, 8], hex(ord(c))


def test_sentences_in_linear_time():
    import time

    unit = "He went to St. Louis with Dr. Lee at 5 p.m. on Elm St. near No. 4. “Oh!” said he. "
    took = []
    for n in (1500, 12000):  # one paragraph, the larger one a megabyte
        began = time.process_time()
        assert len(sentences.sentence_ends(unit * n)) == 2 * n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 1 and took[1] < 30
    began = time.process_time()
    assert len(sentences.item_ends(["A thing."] * 20_000)) == 20_000 and time.process_time() - began < 20


def test_one_long_line_does_not_unwrap_a_text():
    wrapped = "The officer walked along the river for a long time and\nThen came back to the house that stood beside the old\nMill where he had left the car under the trees and the\nSun was gone."
    assert sentences.sentence_ends(wrapped) == [len(wrapped)]
    long = "x" * 150
    assert sentences.sentence_ends(f"{wrapped}\n\n{long}") == [len(wrapped), len(wrapped) + 152]
    assert sentences.width_of([]) == -1 and sentences.width_of(["a", "", "b"]) == -1


HEAD = "Ann Lee interview\n\nParticipants:\n\nOfficer Zoë Ray\nAnn Lee (witness)\n\n"
LAYOUTS = [
    ("Ray: Who?\nANN LEE: Um... me.\nAnd more: yes.\nOfficer Ray: (coughs)\nA. Lee: Fl- floor.\nUnknown voice: Hey.", [("Officer Zoë Ray", "Who?"), ("Ann Lee", "me. And more: yes. floor."), ("unknown", "Hey.")]),
    ("[00:00:09] Rya: Second.\n[00:00:05] Lee: First.", [("Ann Lee", "First."), ("Officer Zoë Ray", "Second.")]),
    (">> ZR: Hi.\n>> AL: Ho.", [("Officer Zoë Ray", "Hi."), ("Ann Lee", "Ho.")]),
    ("00:00:01 Ray\nHello there.\n00:00:03 Lee\nYes.", [("Officer Zoë Ray", "Hello there."), ("Ann Lee", "Yes.")]),
    ("00:00:01.000 --> 00:00:02.000\n<v Ray>Hello.\n\n00:00:03.000 --> 00:00:04.000\n<v Lee>Yes.", [("Officer Zoë Ray", "Hello."), ("Ann Lee", "Yes.")]),
    ("Ray\tHello.\nLee\tYes: no.", [("Officer Zoë Ray", "Hello."), ("Ann Lee", "Yes: no.")]),
    ("Ray – Hello hmm – there.\nLee – Yes.", [("Officer Zoë Ray", "Hello there."), ("Ann Lee", "Yes.")]),
]


def test_transcripts(spark):
    rows = [(i, "c", HEAD + body) for i, (body, _) in enumerate(LAYOUTS)] + [(90, "c", None), (91, None, " "), (92, "c", "[recording failed]"), (93, None, "Participants:\n\nEve Oak (Q)\nTom Elm (A)\n\nQ: Why?\nA. Because.")]
    d = spark.createDataFrame(rows, "id bigint, case_id string, interview_text string").selectExpr("*", "'x' as speaker")
    got = {}
    for r in turns.speaker_turns(d).orderBy("id", "turn_no").collect():
        got.setdefault(r.id, []).append((r.turn_no, r.speaker, r.turn_text))
    for i, (_, want) in enumerate(LAYOUTS):
        assert got[i] == [(k, *w) for k, w in enumerate(want, 1)]
    assert got[93] == [(1, "Eve Oak", "Why?"), (2, "Tom Elm", "Because.")] and not {90, 91, 92} & set(got)
    assert turns.speaker_turns(d.limit(0)).count() == 0


def test_stranger_of_another_roster(spark):
    a = "Participants:\n\nOfficer Rae Marnover\nTim Oak\n\nMarnoven: Hi.\nOak: Yes."
    b = "Participants:\n\nJo Marnoven\n\nMarnoven: Me."
    d = spark.createDataFrame([(1, "c", a), (2, "c", b)], "id bigint, case_id string, interview_text string")
    got = {(r.id, r.turn_no): r.speaker for r in turns.speaker_turns(d).collect()}
    assert got == {(1, 1): "unknown", (1, 2): "Tim Oak", (2, 1): "Jo Marnoven"}


PII = "Mr. Tom Velmar met Ann R. Velmar Jr. Mail tom.velmar [at] box [dot]\ntest or a+b@x.example. Call (555) 555-0123 or +49 30 23125 733. License 000-12-3456, tag 945-13-4015. He lives at 12 Mill Race St., Apt 4 in Redfern. Tom's dog. Ms. Velmar left."


def test_pii_spans(spark):
    docs = spark.createDataFrame([(i, PII) for i in range(3)] + [(9, None), (10, " ")], "row_id bigint, text string").selectExpr("'documents' as src", "row_id", "text", "cast(null as string) as listed", "1 as kind_note")
    got = {}
    for r in pii.find(docs.select("src", "row_id", "text", "listed")).collect():
        got.setdefault(r.row_id, []).append((r.kind, PII[r.start_char : r.end_char]))
    want = {("name", "Tom Velmar"), ("name", "Ann R. Velmar Jr."), ("email", "tom.velmar [at] box [dot]\ntest"), ("email", "a+b@x.example"), ("phone", "(555) 555-0123"), ("phone", "+49 30 23125 733"), ("idnum", "000-12-3456"), ("address", "12 Mill Race St., Apt 4"), ("name", "Tom"), ("name", "Velmar")}
    assert set(got) == {0, 1, 2} and all(set(v) == want for v in got.values())
    out = pii.redact(docs.select("src", "row_id", "text", "listed")).where("row_id = 0").first().redacted_text
    assert out.startswith("Mr. [NAME] met [NAME] Mail [EMAIL] or [EMAIL]. Call [PHONE] or [PHONE]. License [IDNUM], tag 945-13-4015. He lives at [ADDRESS] in Redfern. [NAME]'s dog.")
    assert pii.find(docs.select("src", "row_id", "text", "listed").limit(0)).count() == 0


def test_pii_anchors_are_expanded_where_they_stand():
    find = pii.Finder(set())
    filler = "Nothing here 12 of note. " * 400
    text = f"{filler}Write a.b+c@mail.example.org now. {filler}He lives at 12 Mill Race\nStreet, Unit 5 then. {filler}Licence A123-4567-8901, passport number 123456789, tag 945-13-4015. {filler}It was 987654321. Call +33 1 23 45 67 89. Calle Mayor 5, 3.º B. 4, rue des Aulnes. Hauptstraße 7."
    assert [(k, text[s:e]) for k, s, e in find(text)] == [("email", "a.b+c@mail.example.org"), ("address", "12 Mill Race\nStreet, Unit 5"), ("idnum", "A123-4567-8901"), ("idnum", "123456789"), ("phone", "+33 1 23 45 67 89"), ("address", "Calle Mayor 5, 3.º B"), ("address", "4, rue des Aulnes"), ("address", "Hauptstraße 7")]
    for odd in ("@" * 3000, "5" * 5000, " " * 5000, "+1" * 3000, "1 " * 5000, " St. " * 3000, "[at" * 2000):
        find(odd)


def test_pii_names_in_lists_and_labels():
    find = pii.Finder({"tom", "velmar", "ann", "oak", "zoë", "elm"})
    text = "Participants:\n\nDeputy Tom Velmar\nAnn Oak\nZoë Elm (A)\n\nTom Velmar\tAnn Oak ran. M. Zoë Elm est là.\nT. Velmar: Hm. A. Zoë Elm left. Met Zoë\nElm and Ann R.\nOak."
    assert [text[s:e] for k, s, e in find(text)] == ["Tom Velmar", "Ann Oak", "Zoë Elm", "Tom Velmar", "Ann Oak", "Zoë Elm", "T. Velmar", "Zoë Elm", "Zoë\nElm", "Ann R.\nOak"]


def test_pii_large_lexicon_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, PII) for i in range(3)], "row_id bigint, text string").selectExpr("'d' as src", "row_id", "text", "cast(null as string) as listed")
    a = {tuple(r) for r in pii.find(docs).collect()}
    monkeypatch.setattr(pii, "MAX_LEXICON", 0)
    assert {tuple(r) for r in pii.find(docs).collect()} == a


def test_scan_damage(spark):
    clean = "the officer found the window open near the garden wall and a long-time friend waited"
    page = "Page {}\nRecords Unit\nthe officer found the win-\ndow open near the long-\ntime friend\n"
    rows = [(i, clean) for i in range(30)] + [(100, page.format(1) + page.format(2)), (101, "the officcr found the wind0w"), (102, "one page\nRecords Unit\nmore text"), (103, None), (104, " ")]
    t = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("'documents' as src", "row_id", "text")
    got = {(r.row_id, r.kind) for r in scans.find(t.where("trim(text) != ''")).collect()}
    assert got == {(100, "hyphen"), (100, "header"), (100, "pageno"), (101, "char")}
    assert scans.find(t.limit(0)).count() == 0
    fixed = {r.row_id: r.repaired_text for r in scans.repair(t.where("trim(text) != ''")).collect()}
    assert fixed == {100: "the officer found the window open near the long-time friend the officer found the window open near the long-time friend", 101: "the officer found the window"}


WORDS = "Zoë Jürgen café naïve Größe señor мама вчера пришла домой".split()


def garble(text, true, read):
    out = []
    for b in text.encode(true):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_wrong_encodings(spark):
    clean = "Zoë and Jürgen had a café señor. Мама вчера пришла домой поздно."
    rows = [(i, clean) for i in range(20)] + [(100, garble(clean, "utf-8", "cp1252")), (101, garble("Zoë und Jürgen", "utf-8", "cp437")), (102, garble(garble(clean, "utf-8", "cp1252"), "utf-8", "cp1252")), (103, garble("вчера пришла домой поздно", "koi8_r", "cp1251")),
            (104, "caf� and J�rgen"), (105, "MÃE E A IRMÃ FORAM"), (106, None), (107, ""), (108, garble("窗户碎了但没有血迹。谁最后见过她？", "gb18030", "cp1252")), (109, "plain ascii")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as kinds")
    got = {r.doc_id for r in mojibake.find(d).collect()}
    assert got == {100, 101, 102, 103, 104, 108}
    fixed = {r.doc_id: r.restored_text for r in mojibake.restore(d).collect()}
    assert fixed[100] == fixed[102] == clean and fixed[101] == "Zoë und Jürgen" and fixed[103] == "вчера пришла домой поздно" and fixed[104] == "café and Jürgen" and fixed[108].startswith("窗户碎了")
    assert mojibake.find(d.limit(0)).count() == 0


@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437"])
def test_round_trip_by_form(read):
    text = "Zoë L’Hermoise « déjà » — Größe"
    assert mojibake.by_form(garble(text, "utf-8", read))[0] == text
    assert mojibake.by_form(text) == (text, set())


def test_lost_bytes_need_evidence(spark):
    texts = ["à"] * 5 + ["слово ответ"] * 3 + ["été"] * 2 + ["Birkestrom � a friend", "��� �����", "сло�о", "сл��во", "�t� l����������e"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.restored_text, r.restored) for r in mojibake.restore(d).collect()}
    assert got == {10: ("Birkestrom � a friend", False), 11: ("��� �����", False), 12: ("слово", True), 13: ("слово", True), 14: ("été l����������e", False)}


def test_lattice_with_lost_bytes_and_rare_words(spark):
    rare = "сосед услышал поздний звонок"
    texts = [rare, rare, garble(rare + " Петров", "cp1251", "cp1252"), "Ã�lvarez", "Größe"] + ["Ñ�лово", "слово", "GrÃ¶�Ÿe", "naïve café", "Álvarez"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.restored_text, r.restored) for r in mojibake.restore(d).collect()}
    assert got == {2: (rare + " Петров", True), 3: ("Álvarez", True), 5: ("слово", True), 7: ("Größe", True)}
    assert {r.doc_id for r in mojibake.find(d).collect()} == set(got)


def test_labels_are_assigned_at_least_cost():
    assert turns.matching([[0, 0, 9], [9, 0, 0], [0, 0, 9]]) == {0: 0, 1: 2, 2: 1}
    assert turns.matching([[0, 1], [0, 3]]) == {0: 1, 1: 0} and turns.matching([]) == {}
    roster = ["Ann Marlow", "Tom Marlov", "Sue Marlop"]
    got = turns.assign(["Marlow", "Marlou", "Marlon"], roster)
    assert {line for line, _ in got.values()} == set(roster) and got["Marlow"] == (roster[0], 0.0)
    assert {line for line, _ in turns.assign(["Marlow", "Marloww"], ["Ann Marlow", "Tom Marrw"]).values()} == {"Ann Marlow"}


def test_pii_large_lexicon_asks_for_every_word():
    got = pii.asked("TOM VELMAR saw Ann-Marie Vel-mar. ธารเวล มณีกร")
    assert {"velmar", "ann", "marie", "annmarie", "ann-marie", "\tธารเ"} <= set(got)


def test_pii_large_lexicon_capitals_and_hyphens(spark, monkeypatch):
    texts = [PII] * 3 + ["STATEMENT OF VELMAR\n\nVELMAR spoke. Velmar-Redfern and Vel-mar left."]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string").selectExpr("'d' as src", "row_id", "text", "cast(null as string) as listed")
    a = {tuple(r) for r in pii.find(docs).collect()}
    monkeypatch.setattr(pii, "MAX_LEXICON", 0)
    assert any(r[1] == 3 for r in a) and {tuple(r) for r in pii.find(docs).collect()} == a
