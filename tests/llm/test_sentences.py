import os

import pytest

from weftgraph.llm.sentences import sentences, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


SPLIT = [
    ["Dr. Nakelsa measured approx. 27.6 mm of play, i.e. 9.5% more.", "The film (see No. 33. of the list) was fine."],
    ["We checked belts, rollers, etc.", "Nothing was loose."],
    ["It was built in the U.S.", "Later it was moved."],
    ["The pallets came from Dakor Tools Inc.", "They were short by 43.", "Polymers Co. (SUP00021) shipped 3 units."],
    ["The crew worked until 4 p.m.", "The buyer moved the batch.", "J. T. Vadozel approved it; vol. 82, pp. 94-17,806, is missing."],
    ["The reading... well, it jumped to 10.6 bar.", "pH rose to 22.11."],
    ["He signed at 17:55 hrs.", "pH rose again."],
    ['"Seal torn. We will hold it," said the clerk.', '"Did anyone call Acme Co.?" asked Bo.'],
    ['The buyer wrote: "Torn at 03:29. Failed twice."', "Then no stock was lost."],
    ["“EQ0208 tripped again.”", "That was the whole entry."],
    ["It stopped before noon.", "(The mechanic moved it at 17:03.)", "Was it checked?", "Why 8 instead of 9?!", "Stop!"],
    ["Am 29. Mai wurde der Vertrag verlängert.", "Rollen, z. B. Lager, d. h. Teile, fehlten usw.", "Danach wurde storniert.", "Laut Hr. Traselu lag es am Antrieb, vgl. Abschn. 62, Nr. 44."],
    ["„Bitte anhalten!“, rief die Leitung.", "Der Ausfall dauerte 28,8 Std. und betraf Morkor."],
    ["La Sra. Korbosel dijo: «¿Está cerrado?» y pidió copia.", "¡Hay que parar!", "¿Quién fue?", "Envió 60 cajas, p. ej. de Gel."],
    ["Qui a validé la commande PO1 ?", "Mme Orhalna a répondu : « Il faut arrêter ! » avant de fermer.", "M. Bajor a signalé, cf. art. 52."],
    ["Мастер сменил ремень, датчик и т. д. по списку.", "«Остановите линию!» — крикнул оператор.", "Простой длился 12,8 ч. и стоил 78 тыс. руб. по смете.", "Кто утвердил?"],
    ["قال د. نومال إن السبب هو تلف الحزام.", "من وافق على العقد؟", "أوقفوا الخط فوراً!"],
    ["पर्यवेक्षक डॉ. तरेन ने बेल्ट बदलने को कहा।", "लाइन को तुरंत रोकें!"],
    ['반장은 "일단 멈춥시다. 밸브를 봅시다."라고 말한 뒤 전원을 껐다.', "누가 승인했습니까?"],
    ["สัญญาได้รับการต่ออายุแล้ว", "เครื่องจักรหยุดทำงานเพราะสายพานขาด"],
]
#: Labelled by hand; no text or table of the test data has a part in them.
OTHER_SCRIPTS_AND_CASES = [
    ["ሰላም ነው።", "ደህና ነኝ።"],
    ["မင်္ဂလာပါ။", "နေကောင်းလား။"],
    ["သူ လာ၊ သူမ သွား။", "ပြီးပြီ။"],
    ["សួស្តី។", "អរគុណ។"],
    ["Բարև ձեզ։", "Ինչպես եք։"],
    ["Τι κάνεις;", "Είμαι καλά."],
    ["ߊ߬ ߣߊ߬߹", "ߊ߬ ߕߊ߯߹"],
    ["کیا حال ہے؟", "میں ٹھیک ہوں۔"],
    ["𑀓𑀔𑁇", "𑀕𑀖𑁇"],
    ["I like plan B.", "It works."],
    ["He got an A.", "She got a B."],
    ["It was built by J. Smith.", "It stands."],
    ["John F. Kennedy spoke.", "The end."],
    ["i went home.", "then i slept.", "what happened?", "nobody knows.", "see approx. five."],
    ["Jan. 5 was cold.", "It snowed."],
    ["On 12 ene. 2024 llegó.", "Se fue."],
    ["Le 3 févr. 2024 tout allait bien.", "Puis plus rien."],
    ["Am 5. Okt. 2023 kam er.", "Dann ging er."],
    ["We left 3 days ago.", "5 people came."],
    ["In Dec. the line stopped.", "Next came rain."],
    ["There were two; both broke.", "One was new."],
    ["She lives in Washington, D.C. and works there.", "He does not."],
    ["Version 2.4.1 shipped at 5 p.m.", "Nobody noticed!"],
    ["【注意】必ず止めること。", "次に弁を閉める。"],
]


@pytest.mark.parametrize("parts", OTHER_SCRIPTS_AND_CASES)
def test_scripts_and_casing(parts):
    assert cut(" ".join(parts)) == parts


NO_BLANK = [
    ["班长说：“先停机。再检查阀门。”随后关闭了电源。", "操作员问：“还能继续吗？”没有人回答。", "质检员发现封口不良……但没有报废。", "请停止！"],
    ["班長は「一度止めよう。弁を見る。」と述べて電源を切った。", "振動は2.9から35.27に上昇した。"],
    ["The planner stopped the feed.", "Stop the line now!", "It rose to 20.5 bar.", "Firmware feed_58.cfg.bak v9.8.9 was loaded."],
]


@pytest.mark.parametrize("parts", SPLIT)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\n\n", " \n \n"])
def test_sentences_with_blanks(parts, gap):
    assert cut(gap.join(parts)) == parts


@pytest.mark.parametrize("parts", NO_BLANK)
def test_sentences_without_blanks(parts):
    assert cut("".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


def test_lines_of_their_own():
    text = "Prose here. More prose.\n\nRoot cause\n1) Order one slipped. It was late\n2) No. 3 failed\n\n- first item\n- second. Item\n\n2024-01-02 03:04 EQ1 code=3 load=1.5\n2024-01-02 03:05 EQ1 code=4 load=1.5\n\n" + "0a1b2c3d" * 8 + "\n" + "ffeeddcc" * 8 + "\n\nOpen points\n\nNo mark at the end"
    assert cut(text) == ["Prose here.", "More prose.", "Root cause", "1) Order one slipped. It was late", "2) No. 3 failed", "- first item", "- second. Item", "2024-01-02 03:04 EQ1 code=3 load=1.5", "2024-01-02 03:05 EQ1 code=4 load=1.5", "0a1b2c3d" * 8, "ffeeddcc" * 8, "Open points", "No mark at the end"]


def test_a_missing_mark_before_a_bracket_that_is_a_sentence():
    assert cut("It hit Rye (PRD1) (The mechanic booked a truck at 20:42.) On Monday it ran.") == ["It hit Rye (PRD1)", "(The mechanic booked a truck at 20:42.)", "On Monday it ran."]
    assert cut("They went (see the note of Monday.) and left. Ok (Acme Polymers Tools Inc.) said.") == ["They went (see the note of Monday.) and left.", "Ok (Acme Polymers Tools Inc.) said."]
    assert cut("Tags: le, de, a. Dr. Vo came.") == ["Tags: le, de, a.", "Dr. Vo came."]


def test_title_lines_after_items_and_short_wrapped_lines():
    assert cut("* One thing\nParts and cost\nFollow-up\n\nProse.") == ["* One thing", "Parts and cost", "Follow-up", "Prose."]
    assert cut("With  hopper\n435\nhalf full,  the\nLift lost. Then it\nstopped.") == ["With  hopper\n435\nhalf full,  the\nLift lost.", "Then it\nstopped."]


def test_wrapping_and_invisible_characters_do_not_split():
    assert cut("The pallets came\nfrom Halbo Tools Inc. and\n33. of the list was f​i­ne. Next\tone.") == ["The pallets came\nfrom Halbo Tools Inc. and\n33. of the list was f​i­ne.", "Next\tone."]


@pytest.mark.parametrize("text", [None, "", " ", "\n \n\t　"])
def test_nothing_to_split(text):
    assert sentences(text) == []


def test_unclosed_quotes_and_stray_marks():
    assert cut('He said "never. Then he left. The end.') == ['He said "never.', "Then he left.", "The end."]
    assert cut("One) two. (three. Four.") == ["One) two.", "(three.", "Four."]
    assert cut("...") == ["..."] and cut("?!") == ["?!"] and cut(".") == ["."]


def test_offsets_cover_all_but_blanks():
    text = " Première. « Deux ! » Trois 😀 .\n\n四。五！ \t"
    spans = sentences(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    kept = {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in kept)


def test_very_long_text_in_linear_time():
    assert len(sentences("Ein Satz mit 3,5 mm. " * 50_000)) == 50_000
    assert len(sentences("x" * 500_000)) == 1 and len(sentences("(" * 20_000 + "a.")) == 1


def test_on_a_dataframe(spark):
    df = spark.createDataFrame([("a", "One. Two.", "k"), ("a", "One. Two.", "k"), (None, "Three.", None), ("b", None, None), ("c", " ", None)], "doc_id string, text string, sentence_no string")
    got = sorted((r.doc_id or "", r.sentence_no, r.start_char, r.end_char, r.sentence) for r in split_sentences(df, carry=True).collect())
    assert got == [("", 0, 0, 6, "Three."), ("a", 0, 0, 4, "One."), ("a", 0, 0, 4, "One."), ("a", 1, 5, 9, "Two."), ("a", 1, 5, 9, "Two.")]
    assert split_sentences(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_chunk_windows_of_the_test_tables_are_runs_of_sentences():
    """The chunks were cut from the true sentences, three at a time; nearly all must be runs of ours."""
    duckdb = pytest.importorskip("duckdb")
    squeeze = lambda s: " ".join(s.split())
    docs = dict(duckdb.sql("select document_id, text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall())
    good = total = 0
    for doc, seq, text in duckdb.sql("select distinct doc_id, seq, text from '/root/testdata/sf0.01/chunks.parquet'").fetchall():
        if doc in docs:
            s = [squeeze(x) for x in cut(docs[doc])]
            total += 1
            good += any(" ".join(part) == squeeze(text) for part in (s[3 * seq : 3 * seq + 3], s[-3:]))
    assert total > 2500 and good / total > 0.99
