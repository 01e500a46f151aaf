"""Sentences, personal information, page templates, defective pairs."""

import random

import pytest

from millrace.llm import boilerplate as bp
from millrace.llm import pairs, pii
from millrace.llm.sentences import sentences, split

SENTENCES = [
    ('He left (quickly). She stayed! "No way," he said. "Really? Yes." Then it ended.', ["He left (quickly).", "She stayed!", '"No way," he said.', '"Really? Yes."', "Then it ended."]),
    ("Er kam am 3. Mai. Dann ging er z. B. heim. Das Haus Nr. 5 ist leer.", ["Er kam am 3. Mai.", "Dann ging er z. B. heim.", "Das Haus Nr. 5 ist leer."]),
    ("दूरी 79.12 कि.मी. है। फिर डॉ. अनवी आए।", ["दूरी 79.12 कि.मी. है।", "फिर डॉ. अनवी आए।"]),
    ('2016. 3. 4. 기준 담당은 팀이다.편찬실은 "빠졌습니다. 다시 하세요."라고 답했다.', ["2016. 3. 4. 기준 담당은 팀이다.", '편찬실은 "빠졌습니다. 다시 하세요."라고 답했다.']),
    ("他说：“不知道。”剩下的交给他。“走吧！”某人喊道。", ["他说：“不知道。”", "剩下的交给他。", "“走吧！”某人喊道。"]),
    ("「はい。終わり？」と言った。値は３．5だった。係は……いや、別だ。", ["「はい。終わり？」と言った。", "値は３．5だった。", "係は……いや、別だ。"]),
    ("ทำไมดัชนีหาย เปิดในปี 2031 และมีผู้เดิน ห้ามส่งต่อ", ["ทำไมดัชนีหาย", "เปิดในปี 2031 และมีผู้เดิน", "ห้ามส่งต่อ"]),
    ("—¿Y la ficha? —preguntó ella. El Sr. Gil firmó la pág. 3, p. ej. hoy.", ["—¿Y la ficha? —preguntó ella.", "El Sr. Gil firmó la pág. 3, p. ej. hoy."]),
    ("« Non ! » a crié Jean. Personne... sauf M. Roux.", ["« Non ! » a crié Jean.", "Personne... sauf M. Roux."]),
    ("# Head. One\n- item. two\n\nA line\nbroken. Next", ["# Head. One", "- item. two", "A line\nbroken.", "Next"]),
    ("It costs $3.50 at 5 p.m. We left. See a.b.pdf, Sec. 3.84, e.g. now. J. R. Hill came.", ["It costs $3.50 at 5 p.m.", "We left.", "See a.b.pdf, Sec. 3.84, e.g. now.", "J. R. Hill came."]),
]


@pytest.mark.parametrize("text,want", SENTENCES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


#: Held-out cases: text, and the spans in it with their types.
PERSONAL = [
    ("My colleague Maria Garcia called yesterday.", [("Maria Garcia", "name")]), ("Regards,\nJohn Smith", [("John Smith", "name")]), ("Ann Lee signed the form and Bob Ray paid.", [("Ann Lee", "name")]),
    ("Wohnhaft in der Hauptstraße 5, 10115 Berlin seit Mai", [("Hauptstraße 5, 10115 Berlin", "address")]), ("住所は東京都千代田区丸の内1-1-1です", [("東京都千代田区丸の内1-1-1", "address")]), ("地址是北京市海淀区中关村大街27号", [("北京市海淀区中关村大街27号", "address")]),
    ("Card 4111 1111 1111 1111 was charged", [("4111 1111 1111 1111", "id_number")]), ("Card 4111 1111 1111 1112 was charged", []), ("IBAN DE89 3704 0044 0532 0130 00 please", [("DE89 3704 0044 0532 0130 00", "id_number")]), ("SSN 000-00-0000", []), ("SSN 123-45-6789", [("123-45-6789", "id_number")]),
    ("write to mailto:ann@ex.org or tel:+15551234567", [("ann@ex.org", "email"), ("+15551234567", "phone")]), ("see https://user:secret@host.example/x", []), ("au 12 rue de la Paix, 75002 Paris", [("12 rue de la Paix, 75002 Paris", "address")]),
    ("Madison Park Hospital is open. The Charles River was low. John Deere City is a game.", []), ("The Thomas Method was used and Grace Hall, the venue, closed.", []),
]


@pytest.mark.parametrize("text,want", PERSONAL)
def test_held_out_personal_information(text, want):
    assert [(text[a:b], k) for a, b, k in pii.spans(text)] == want


#: Scripts with their own full stops, and spaces for full stops; | is a boundary.
SCRIPTS = [
    "ខ្ញុំទៅផ្សារ។|គាត់មក។", "သူသွားသည်။|ငါလာသည်။", "ང་འགྲོ་གི་ཡིན།|ཁོང་ཕེབས་སོང་།", "እኔ ሄድኩ።|እሱ መጣ።", "Նա գնաց։|Ես եկա։", "彼は来た｡|私は行く｡", "昨天我去了学校 |老师没有来 |我们就回家了", "北京市 海淀区", "重要会议 社会问题 现在",
    "今日は雨だった |明日は晴れるだろう", "Really⁉ |Yes‼ |Good.", "ᠪᠢ ᠶᠠᠪᠤᠪᠠ᠃ |ᠲᠡᠷᠡ ᠢᠷᠡᠪᠡ᠃",
]


@pytest.mark.parametrize("marked", SCRIPTS)
def test_scripts(marked):
    text, want = marked.replace("|", ""), [x.strip() for x in marked.split("|")]
    assert [text[a:b] for a, b in sentences(text)] == want


#: Ordinary words that begin like a particle, particles, and plain final forms; | is a boundary.
JAPANESE = [
    *(f"彼は「そうだ。」|{w}帰った。" for w in ("とても急いで", "でも、すぐ", "はい、と答えて", "もし雨なら", "もちろん", "がっかりして", "やがて", "にっこりして", "のちに", "ところが客は")),
    *(f"彼は「そうだ。」{w}。" for w in ("と言った", "とつぶやいた", "という声がした", "は正しい", "はいい言葉だ", "もした", "でもいい", "です", "とは言わない", "でした", "から始まる", "が口癖だ", "のように話した")),
    "雨だ……|しかし行く。", "もう帰った……|でも、暗い。", "誰も知らない……|もちろん私も。", "まだ……しかし行く。", "あなた……でも、いい。", "いったい……なぜ来た。",
    "今日は雨だ　|明日は晴れる。", "雨が降った　|しかし私は行く。", "昨日会った　人が来た。", "そうですね　|明日行きます。", "ますます　暑い。",
]


@pytest.mark.parametrize("marked", JAPANESE)
def test_japanese_words_compete_with_particles(marked):
    text = marked.replace("|", "")
    assert [text[a:b] for a, b in sentences(text)] == [x.strip() for x in marked.split("|")]


def test_sentences_cover_all_but_white_space():
    r = random.Random(7)
    for _ in range(400):
        t = "".join(r.choices(["word", "Word", ". ", "! ", "? ", "\n", "\n\n", "3.5", "e.g. ", "“", "”", "(", ")", '"', "한국어다.", "日本。", " ", "- x", "…"], k=r.randint(0, 40)))
        spans = sentences(t)
        inside = "".join(t[a:b] for a, b in spans)
        assert "".join(inside.split()) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_sentence_operator(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n ", "c"), (4, "One. Two.", "d"), (4, "One. Two.", "d"), (5, "long. " * 20000, "e")], "doc_id bigint, text string, start_pos string")
    rows = split(df).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in rows} == {(4, 4), (5, 1)}
    assert split(df.limit(0)).count() == 0


PII = [
    ("Mail a.b+c@x-y.example, now.", [("a.b+c@x-y.example", "email")]),
    ("회신은 kim ＠ mail.co.example로", [("kim ＠ mail.co.example", "email")]),
    ("ab (at) hr (dot) foo (dot) test, ok", [("ab (at) hr (dot) foo (dot) test", "email")]),
    ("Install kit@7.13.2, mute @channel", []),
    ("급하면010-1234-5678으로, ０１０－１２３４－５６７８ 또는 (02) 123-4567", [("010-1234-5678", "phone"), ("０１０－１２３４－５６７８", "phone"), ("(02) 123-4567", "phone")]),
    ("Call+1 425 555 0100 or (425) 555-0100 (+44 20 7946 0336)", [("+1 425 555 0100", "phone"), ("(425) 555-0100", "phone"), ("+44 20 7946 0336", "phone")]),
    ("doc_0102345678_chunk_003, ticket 203154-82-7, 2031-04-12, 192.0.2.57, 3.14159265358979, 12,345,678", []),
    ("주민등록번호 530213-1042614, 면허번호는 25-37-912498-64", [("530213-1042614", "id_number"), ("25-37-912498-64", "id_number")]),
    ("Her ID number is QQ 26 90 86 A. ID: 990-15-7144", [("QQ 26 90 86 A", "id_number"), ("990-15-7144", "id_number")]),
    ("수령인 김하늘, 단비시 벼리구 하늬로12길 5, 101동 202호로 보내", [("김하늘", "name"), ("단비시 벼리구 하늬로12길 5, 101동 202호", "address")]),
    ("주소가 미르도 벼리군 새론리 산 52번지에서", [("미르도 벼리군 새론리 산 52번지", "address")]),
    ("Ship to Ann B. O'Neil, Flat 5, 12 Oak Hill Road, Port Vale 12345. Thanks", [("Ann B. O'Neil", "name"), ("Flat 5, 12 Oak Hill Road, Port Vale 12345", "address")]),
    ("남궁민수 씨와 이보람 씨가, 새론 씨앗 도서전", [("남궁민수", "name"), ("이보람", "name")]),
    ("고객님께, 담당자는 설정 파일을", []),
]


@pytest.mark.parametrize("text,want", PII)
def test_personal_information(text, want):
    assert [(text[a:b], k) for a, b, k in pii.spans(text)] == want


def test_redaction_keeps_the_rest(spark):
    assert pii.redact("x a@b.example y") == "x [EMAIL] y" and pii.redact(None) is None and pii.redact("") == ""
    row = [(1, "a@b.example", None, [("call 425-555-0100", "c")], "t1"), (1, "a@b.example", None, [("call 425-555-0100", "c")], "t2"), (2, None, "", None, "t"), (3, "x", "y", [], "t")]
    df = spark.createDataFrame(row, "log_id bigint, question string, answer string, contexts array<struct<text:string,chunk_id:string>>, pii_type string")
    got = sorted(tuple(x) for x in pii.find(df).collect())
    assert got == [(1, "contexts", 0, 5, 17, "phone"), (1, "question", -1, 0, 11, "email")]
    out = {r.log_id: r for r in pii.redact_columns(df, ["question", "answer", "contexts"]).collect()}
    assert out[1].question == "[EMAIL]" and out[1].contexts[0].text == "call [PHONE]" and out[1].contexts[0].chunk_id == "c" and out[2].question is None and out[2].contexts is None
    assert pii.find(df.limit(0)).count() == 0


def site(n=60):
    r = random.Random(1)
    pages, truth = [], {}
    for i in range(n):
        word = lambda: "".join(r.choices("abcdefghij", k=6))
        body = [f"Subject {i % 7}", f"{word()} tells of {word()} and {word()}. It goes on.", f"{word()} was said by {word()} to {word()}. Done."]
        lines = ["Home | About | Contact", "Home / Topics", body[0], body[1], "", "Read also: Subject " + str((i + 1) % 7), body[2], "Most read", f"1 Subject {(i + 2) % 7}", f"2 Subject {(i + 3) % 7}", "", "© 2024 The Site. All rights reserved.", "Privacy | Terms"]
        pages.append((f"d{i}", f"Subject {i % 7}", f"https://www.site.example/{i}", "\n".join(lines)))
        truth[f"d{i}"] = {0, 1, 5, 7, 8, 9, 11, 12}
    return pages, truth


def test_templates(spark):
    pages, truth = site()
    docs = spark.createDataFrame([*pages, pages[0], ("none", None, None, None), ("empty", "", "", "")], "doc_id string, title string, url string, text string")
    chunks = spark.createDataFrame([("c0", "d0", None, None, "\n".join(pages[0][3].split("\n")[6:10])), ("c1", "gone", None, None, "Most read\n1 Subject 3\nA new sentence of its own."), ("c2", "d1", None, None, None)], "chunk_id string, doc_id string, title string, url string, text string")
    got = {}
    for r in bp.not_body(docs, chunks).collect():
        got.setdefault(r.item_id, set()).add(r.line_no)
    assert {k: v for k, v in got.items() if k.startswith("d")} == truth
    assert got["c0"] == {1, 2, 3} and got["c1"] == {0, 1} and "c2" not in got
    bodies = {r.doc_id: r.text for r in bp.bodies(docs.dropDuplicates(["doc_id"]), "doc_id", bp.not_body(docs, chunks)).collect()}
    assert bodies["d3"].startswith("Subject 3\n") and bodies["none"] is None and bodies["empty"] == ""
    assert bp.not_body(docs.limit(0), chunks.limit(0)).count() == 0


def test_templates_of_many_small_hosts(spark):
    """A menu that thirty hosts share, each with one page."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    pages = [(f"d{i}", f"Subject {word()}", f"https://www.host-{word()}.example/{i}", f"Member area\n{word()} tells of {word()} and {word()}. It goes on.\n{word()} was said by {word()} to {word()}. Done.") for i in range(30)]
    docs = spark.createDataFrame(pages, "doc_id string, title string, url string, text string")
    chunks = spark.createDataFrame([], "chunk_id string, doc_id string, title string, url string, text string")
    assert {(x.item_id, x.line_no) for x in bp.not_body(docs, chunks).collect()} == {(f"d{i}", 0) for i in range(30)}


def qa(n=400):
    """Invented pairs with their defects."""
    r = random.Random(3)
    teams = ["planning office", "field crew", "legal team", "review board"]
    rows, want = [], {}
    for i in range(n):
        place, team, days = f"Place{i % 40}", r.choice(teams), r.randint(2, 90)
        q = f"Who runs table extraction at the {place} library?" if i % 2 else f"How many days does the {place} archive allow for reviews?"
        a = f"At the {place} library, the {team} is responsible for table extraction." if i % 2 else f"The {place} archive allows {days} days for reviews."
        t = a if i % 3 else None
        kind = {0: "empty", 1: "truncated", 2: "refusal", 3: "copied_question", 4: "wrong_language"}.get(i % 20)
        if kind == "empty":
            a = r.choice([None, "", " ", "...", "N/A", "Answer:", "​"])
        elif kind == "truncated":
            a = a[: len(a) * 2 // 3].rstrip(" .")
        elif kind == "refusal":
            a = r.choice(["I don't know.", "I'm sorry, but I can't help with that.", "There isn't enough information in the documents to say."])
        elif kind == "copied_question":
            a = r.choice([q, q.upper(), f"Question: {q}", f"{q} {q}"])
        elif kind == "wrong_language":
            a = f"{place} 도서관의 표 추출 업무는 총무팀에서 맡고 있습니다."
        elif i % 20 == 5:
            a, t = "I don't know.", "no answer in the documents"
        elif i % 20 == 6:
            q, a = q + " Please answer in Korean.", f"{place} 도서관의 표 추출 업무는 총무팀에서 맡고 있습니다."
        elif i % 20 == 7:
            a = "I could not find the exact reason, but " + a[0].lower() + a[1:]
        rows.append((i, q, a, t, "x"))
        if kind:
            want[i] = kind
    return rows, want


def test_defects_of_invented_pairs(spark):
    rows, want = qa()
    df = spark.createDataFrame([*rows, rows[1]], "log_id bigint, question string, answer string, ground_truth string, defects string")
    got = {r.log_id: r.defect for r in pairs.found(df).collect()}
    wrong = {i: (got.get(i), want.get(i)) for i in set(got) | set(want) if got.get(i) != want.get(i)}
    assert len(wrong) <= 0.02 * len(rows), wrong
    odd = spark.createDataFrame([(1, None, None, None), (None, "q?", "a b c.", ""), (2, "", "x" * 50000, None)], "log_id bigint, question string, answer string, ground_truth string")
    assert {r.log_id for r in pairs.label(odd).collect()} == {1, 2, None}
    assert pairs.found(odd.limit(0)).count() == 0


def test_votes_do_not_depend_on_copies_or_size(spark):
    rows = [(i, q, a, t) for i, q, a, t, _ in qa(100)[0]] + [(1000, "Why?", "- first\n- second thi", None), (1001, "Who runs it?", "The office that keeps the regis", None)]
    many = [(i + 10000 * k, q, a, t) for k in range(6) for i, q, a, t in rows]
    schema = "log_id bigint, question string, answer string, ground_truth string"
    once, copied = ({r.log_id: r[1:] for r in pairs.vote(spark.createDataFrame(x, schema)).collect()} for x in (rows, many))
    assert all(copied[i + 10000 * k] == once[i] for i in once for k in range(6))
    for n in range(1, 12):
        tail = [(n, 0), (n, n // 2), (n // 2, n // 2), (1, 1)]
        few, more = (pairs.votes("Who runs it?", "The office that keeps the regis", None, [(k * x, k * e) for x, e in tail], 6000 * k) for k in (1, 10))
        assert few == more


def test_label_model_recovers_rates():
    r = random.Random(0)
    counts = {}
    truth = {}
    for _ in range(4000):
        y = r.random() < 0.2
        p = tuple((1 if y else -1) * (1 if r.random() < acc else -1) if r.random() < 0.8 else 0 for acc in (0.9, 0.85, 0.8, 0.95))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    post = pairs.fit(sorted(counts.items()))
    # Held-out accuracy of the posterior at one half, against the known truth.
    right = sum(sum(y == (post[p] > 0.5) for y in ys) for p, ys in truth.items())
    assert right / 4000 > 0.93
    assert pairs.fit([]) == {}
