"""Encodings by round trip, sentences by hand, languages on held-out samples, scans and pages on small fixtures."""

import pytest
from pyspark.sql import functions as F

from mycelia.llm import encoding, language, mainbody, residue, scans, sentences

CLEAN = [
    ("en", "The naïve reader isn’t sure – not at 5 °C. It is café-sized, said the note."), ("en", "The group measured the matrix again and found the façade."),
    ("fr", "La fréquence dépend de la variation du théorème. Il s’agit de chaleur, de lumière, etc."), ("fr", "Quand la sphère devient thermique, l’énergie le devient aussi."),
    ("de", "Früher nannte man die Größe einfach so. Jede Sichtung stärkt die Verbindung zwischen den Körpern."), ("es", "También se estudió la variación de la presión con más atención."),
    ("ru", "Однако каждое повторение усиливает связь между узлами. Что произойдёт, если теплота исчезнет?"), ("ru", "Почему масса не убывает со временем? Группа измерила изменение энергии."),
    ("uk", "Якщо рідина мала, то й пам’ять обмежена. Що станеться, якщо хвиля зникне?"), ("zh", "我们把推理定义为压强的一种度量。"), ("ja", "繰り返すたびに電荷と記憶の結びつきが強くなる。"),
    ("hi", "यदि स्मृति न हो तो क्या होगा?"), ("th", "ดังนั้นความหนาแน่นจึงเพิ่มขึ้นทีละขั้น"),
]
SAMPLES = [t for _, t in CLEAN]
RECORD = "rec_id bigint, elem_type string, file_path string, source string, lang string, text string, tokens array<struct<lemma:string,dep:string,head_offset:int>>, state string"


def sample_table(spark):
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(CLEAN)], "sample_id int, lang string, text string")


def records(spark, rows):
    return spark.createDataFrame([(i, "text", path, "site-a", lang, text, [(x, "d", 0) for x in lemmas] if lemmas is not None else None, "e") for i, path, lang, text, lemmas in rows], RECORD)


@pytest.fixture(scope="module")
def repairer():
    return encoding.Repairer(SAMPLES)


def garble(text, true, wrong):
    table = encoding.byte_to_char(wrong)
    return "".join(table[b] for b in text.encode(true))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "mac_roman"])
def test_utf8_round_trip(repairer, wrong):
    for text in SAMPLES:
        bad = garble(text, "utf-8", wrong)
        fixed, state, places = repairer.repair_mapped(bad)
        if bad == text:
            assert state is None
            continue
        assert state == "restorable" and fixed == text
        assert len(places) == len(fixed) and all(bad[p] == c for p, c in zip(places, fixed) if c.isascii())
    twice = garble(garble(SAMPLES[2], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert repairer.repair(twice) == (SAMPLES[2], "restorable")


def test_single_byte_pairs_and_mixed_text(repairer):
    for true, wrong in (("cp1251", "cp1252"), ("cp866", "cp1251"), ("koi8-r", "cp1251")):
        assert repairer.repair(garble(SAMPLES[6], true, wrong))[1] == "restorable"
    assert repairer.repair("The naпve reader")[0] == "The naïve reader"
    mixed = SAMPLES[6] + " " + garble(SAMPLES[2], "utf-8", "cp1252")
    assert repairer.repair(mixed) == (SAMPLES[6] + " " + SAMPLES[2], "restorable")


def test_what_is_no_case(repairer):
    for text in [*SAMPLES, "Letters such as Ð, Þ or â name it. The sign Ã, read as in x.", "café", "naïve", "What? Really?", "« Est-ce vrai ? » demanda-t-il.", "", None, "x" * 20000]:
        assert repairer.repair(text) == (text, None)
    for text in ("caf? – ?so?", "??? ????", "thermi�que", "W?rme"):
        assert repairer.repair(text)[1] == "lost"


def test_garbled_records(spark):
    rows = [(1, "a.txt", "fr", garble("thermique à été", "utf-8", "cp1252"), ["ok"]), (2, "a.txt", "fr", "clean", [garble("été", "utf-8", "cp1252"), None, ""]), (3, "a.txt", "fr", "bad �", None), (4, "a.txt", None, None, [])]
    got = {tuple(r) for r in encoding.garbled_records(records(spark, rows + rows[:1]), sample_table(spark)).collect()}
    assert got == {(1, "text", "restorable"), (2, "lemma", "restorable"), (3, "text", "lost")}


SPLITS = [
    ("Dr. Brisko kept it near 5.9 K, i.e. well below the limit. K. R. Quorrin left. See Fig. 3 and Eq. 8.5.", 3),
    ("“The mass is thermal!” wrote K. R. Oldenquay in the margin. Next one.", 2),
    ("«Сохраняется ли масса?» — спросил проф. Остмер. Речь идёт о тепле и т. д. В 1951 г. масса росла, т. е. падала.", 3),
    ("« La masse est-elle thermique ? » demanda le Dr Ostmere. M. Brisko mesure 5 unités ! Fin.", 3),
    ("1. First item. 2. Second item.\n3. Third item.", 3),
    ("A heading\n\nThe text goes\non here.", 2),
    ("他说：“概念是恒定的。”2015年测得的光谱为30.8。“密度守恒吗？”塔某问道。熵……并不总是对称。", 4),
    ("「電荷は保存されるのか？」とベルク氏は尋ねた。図8.8では格子が約1.4である。", 2),
    ("“क्या सतह स्थिर है?” ऐसा प्रो. ओस्टमेर ने पूछा। यदि शक्ति न हो तो क्या होगा?", 2),
    ("นักวิจัยวัดความดันได้ 33.2 หน่วยในการทดลองนี้ ในปี พ.ศ. 451 มีการวัดพลังงานเป็นครั้งแรก", 2),
    ("Am 9. Mai 1953 wurde es z. B. in Lirona geprüft. „Ist es wahr?“, fragte Prof. Brisko.", 2),
    ("The file notes.v3.txt lists 5.5 W. It stays slowly.In other words, it ends. (See also p. 3.) Then etc.", 5),
    ("The wave ... was never local. It grows", 2),
    ("a", 1), ("", 0), ("  \n ", 0), (None, 0), ("...", 0), ("word " * 20000, 1),
]


def test_sentences(spark):
    rows = [(i, "a.txt", "en", t, None) for i, (t, _) in enumerate(SPLITS)] + [(100, "b.HTML", "en", "Not. This.", None), (101, "c.PDF", "en", "Nor. This.", None), (102, None, "en", "No path.", None), (103, "x.txt", "en", "lost �. Text.", None)]
    found = sentences.sentence_units(records(spark, rows), sample_table(spark)).collect()
    starts = {}
    for r in found:
        starts.setdefault(r.rec_id, []).append((r.start_pos, r.unit))
    for i, (text, n) in enumerate(SPLITS):
        got = sorted(starts.get(i, []))
        assert len(got) == n, (text, got)
        assert all(text[p : p + 5] == u[:5] for p, u in got)
    assert 102 in starts and not {100, 101, 103} & set(starts)


def test_starts_in_garbled_text_are_places_of_the_stored_text(spark):
    bad = garble("Été froid à Lyon. Là, il pleut.", "utf-8", "cp1252")
    got = sorted(r.start_pos for r in sentences.sentence_starts(records(spark, [(1, "a.txt", "fr", bad, None)] * 2), sample_table(spark)).collect())
    assert got == [0, bad.index("L\u00c3")]


def test_records_of_no_page_are_plain_text(spark):
    paths = ["a.txt", "a", "", None, "a.html.txt", "a.html ", "a.html\n", "a.html\r\n", "a.pdf\x85", "a.pdf\u2028", "a.HTML", "a.Pdf", "a\n.html"]
    rows = [(i, path, "en", "One. Two.", None) for i, path in enumerate(paths)]
    got = sorted((r.rec_id, r.start_pos) for r in sentences.sentence_starts(records(spark, rows), sample_table(spark)).collect())
    assert got == [(i, p) for i in range(10) for p in (0, 5)]


def test_languages(spark):
    own = {lang: " ".join(t for k, t in CLEAN if k == lang) for lang in dict(CLEAN)}
    c = language.Classifier(own)
    assert [x for x, _ in c.record("La variación de la presión se estudió con más atención también.")[0]] == ["es"]
    assert [x for x, _ in c.record("Jede Sichtung stärkt die Verbindung. 我们把推理定义为压强。 Früher nannte man die Größe einfach so.")[0]] == ["de", "zh", "de"]
    rows = [
        (1, "a.txt", "RU-ru", "Однако каждое повторение усиливает связь между узлами.", None), (2, "a.txt", "en", "Почему масса не убывает со временем?", None), (3, "a.txt", None, "Що станеться, якщо хвиля зникне?", None),
        (4, "a.txt", "en", None, None), (5, "a.txt", "en", " ", None), (6, "b.txt", "und", "42.", None), (7, "c.txt", "de_AT", "Früher nannte man die Größe einfach so. Почему масса не убывает?", None),
    ]
    got = sorted((r.rec_id, r.seg_no, r.lang) for r in language.language_report(records(spark, rows + rows[1:2]), sample_table(spark)).collect())
    assert got == [(2, 1, "ru"), (3, 1, "uk"), (7, 1, "de"), (7, 2, "ru")]
    assert language.language_report(records(spark, rows).limit(0), sample_table(spark)).count() == 0


def test_cyrillic_without_deciding_letters(spark):
    own = {lang: " ".join(t for k, t in CLEAN if k == lang) for lang in dict(CLEAN)}
    own["ru"] += " Сначала нужно проверить, что теплота постоянна! Если мера случайна, то и частица неизвестна."
    own["uk"] += " Що станеться, якщо густина зникне? Без поняття маси не можна пояснити силу."
    c = language.Classifier(own)
    french = "Quand la sphère devient thermique, l’énergie le devient aussi."
    assert [x for x, _ in c.record(f"Сначала нужно проверить, что мера конечна! {french}")[0]] == ["ru", "fr"]
    assert [x for x, _ in c.record(f"Без поняття густини не можна пояснити міру. {french} Что если теплота мала?")[0]][:2] == ["uk", "fr"]
    assert c._own({"ru": 60, "uk": 40}, 30)[0] == "uk"
    # sentences that recur within lines enter the dictionary of the label they stand under
    rows = [(i, "a.txt", "ru", f"Волна {'абвгдежзик'[i]} мала. Доктор удерживал температуру около {i} единиц. Связь {'абвгдежзик'[i]}.", None) for i in range(10)]
    assert "Доктор удерживал температуру около # единиц." in dict(language.dictionaries(records(spark, rows), sample_table(spark)))["ru"]


def test_scans(spark):
    body = "The matrix grows with the particle and the theorem follows the pendulum again.\n"
    page = "site-a · Five facts about waves\nThe thcorem grows with the parti-\ncle and the well-\nknown pendulum (CO2, x1, 3D).\n1954.\n- 6 -"
    rows = [(1, "s.pdf", "en", page, None), (2, "s.pdf", "en", "FIVE FACTS ABOUT WAVES   7\nThe matr1x stays.\n· 7 ·\n\nPage l8", None), (3, "s.pdf", "en", None, None)]
    rows += [(10 + i, "t.txt", "en", body + "A well-known theorem and a well-known particle.", None) for i in range(12)]
    got = {tuple(r) for r in scans.lines_to_repair(records(spark, rows + rows[:1]), sample_table(spark)).collect()}
    assert got == {(1, 0, "furniture"), (1, 5, "furniture"), (1, 1, "break"), (1, 1, "chars"), (2, 0, "furniture"), (2, 1, "chars"), (2, 2, "furniture"), (2, 4, "furniture")}
    texts = [r.text for r in scans.paragraphs(records(spark, rows + rows[:1]), sample_table(spark)).orderBy("par_no").collect()]
    assert texts == ["The theorem grows with the particle and the well-known pendulum (CO2, x1, 3D). 1954. The matrix stays."]
    assert scans.lines_to_repair(records(spark, rows).limit(0), sample_table(spark)).count() == 0


def test_weighted_distance_and_deletes():
    assert scans.deletes("abc") == {"abc", "bc", "ac", "ab"} and "fher" in scans.deletes("früher") and "cat" not in scans.deletes("zz")
    assert scans.distance("theorem", "thcorem", 6.0) == (1.0, 2, 2) and scans.distance("comme", "comrne", 6.0)[0] == 0.8
    assert round(scans.distance("wonder", "wnder", 6.0)[0], 9) == 3.6 and scans.distance("wave", "boats", 6.0) is None
    assert scans.distance("früher", "friiher", 6.0)[1:] == (2, 3) and scans.distance("früher", "fruher", 6.0)[0] == 1.2


def test_misreads_outside_the_table(spark):
    clean = "The spectrum of the pendulum grows slowly. They compared the spectrum with the theory of the pendulum again.\n" * 12
    # two errors in a word, a lost letter, a wrong letter of no known pair, and one on either part of a divided word
    page = "The spcctrurn of it. The pendlum of it.\nThe spextrum of it stays.\nThey compared.\nThe spec-\ntrurn of the pcn-\ndulum again.\nThe naxos stays ou†side."
    rows = [(1, "s.pdf", "en", page, None)] + [(10 + i, "t.txt", "en", clean, None) for i in range(40)]
    table = records(spark, rows)
    found = {(r.line_no, r.word, r.repair, r.path) for r in scans.line_repairs(table, sample_table(spark)).where("kind = 'chars'").collect()}
    assert found == {
        (0, "spcctrurn", "spectrum", "index"), (0, "pendlum", "pendulum", "index"), (1, "spextrum", "spectrum", "index"), (4, "spectrurn", "spectrum", "index"),
        (4, "pcndulum", "pendulum", "index"), (6, "ou†side", None, "looks"),
    }
    wide = table.withColumn("word", table.text).withColumn("n", table.rec_id)  # clashing names are not read
    assert scans.lines_to_repair(wide, sample_table(spark)).where("kind = 'chars'").count() == 4


def test_borders_of_stretches_change_nothing(spark, monkeypatch):
    from mycelia.llm import pages

    body = "The matrix grows with the particle and the theorem follows the pendulum again.\n"
    rows = [(i, "s.pdf", "en", "The thcorem grows with the parti-" if i % 2 else "cle and the matrix.", None) for i in range(1, 40)]
    rows += [(100 + i, "t.txt", "en", body, None) for i in range(200)]
    whole = {tuple(r) for r in scans.lines_to_repair(records(spark, rows), sample_table(spark)).collect()}
    monkeypatch.setattr(pages, "STRETCH", 7)
    monkeypatch.setattr(pages, "OVERLAP", 3)
    assert {tuple(r) for r in scans.lines_to_repair(records(spark, rows), sample_table(spark)).collect()} == whole
    assert {(i, 0, k) for i in range(1, 39, 2) for k in ("break", "chars")} <= whole
    text = " ".join(r.text for r in scans.paragraphs(records(spark, rows), sample_table(spark)).orderBy("stretch", "par_no").collect())
    assert text.count("particle") == 19 and text.split().count("theorem") == 20 and "parti " not in text and " cle " not in text


def test_pages(spark):
    rows, expected = [], set()
    nouns = ["matrix", "theorem", "particle", "lattice", "vector", "cylinder", "membrane", "photon"]
    for i in range(24):
        a, b = nouns[i % 8], nouns[(i * 3 + 1) % 8]
        lines = [
            "Home | Help | Search", "We use cookies here, accept them all please.", f"The {a}: an introduction", f"The {a} grows with the {b} of the old {'abcdefgh'[i % 8]}{'klmnopqr'[i // 8]} kind, and the {b} stays closed.", f"Read also: The {b}: an introduction",
            a.capitalize(), f"Without the {b} of case {i} there would be no {a}, as {'abcdefgh'[i % 8]}{'klmnopqr'[i % 7]} noted.", "", "Related articles", f"Five facts about the {b}", "Back to top",
        ]
        for k in (0, 1, 4, 8, 9, 10):
            expected.add((i, k))
        rows.append((i, f"p{i}.Html", "en", "\n".join(lines), None))
    got = {tuple(r) for r in mainbody.lines_outside(records(spark, rows + rows[:2]), sample_table(spark)).collect()}
    assert got == expected
    assert mainbody.lines_outside(records(spark, [(1, "a.html", "en", None, None), (2, "a.txt", "en", "x", None)]), sample_table(spark)).count() == 0


def test_the_density_decides(monkeypatch):
    model = {"recurring": frozenset(["home help search", "accept all cookies please"]), "words": frozenset("matrix theorem grows with the of".split()), "shapes": frozenset()}
    page = ["Home | Help | Search", "The matrix at home", "The matrix grows with the theorem of the old kind, and it stays closed.", "Accept all cookies please.", "Matrix", "The theorem grows.", "The theorem grows with the matrix of the new kind, too.", "Five facts about it", "Accept all cookies please."]
    right = [True, False, False, True, False, False, False, True, True]
    assert mainbody.Page(model).outside(page, "site") == right
    body = (100.0, 50.0, 10.0, 5.0)
    assert mainbody.Page.density((50.0, 50.0, 5.0, 5.0), body) == 0 < mainbody.Page.density((50.0, 25.0, 5.0, 5.0), body) < mainbody.Page.density((50.0, 0.0, 1.0, 0.0), body)
    monkeypatch.setattr(mainbody.Page, "density", staticmethod(lambda node, body: 1.0))
    assert mainbody.Page(model).outside(page, "site") == [False] * 9


def test_what_recurs_on_a_site_only(spark, monkeypatch):
    rows = [(i, f"s{i}.html", "en", f"Quux warble number {'abcdefghijkl'[i]}\nZaphod beeblebrox" if i < 4 else f"Own line {'abcdefghijkl'[i]} here", None) for i in range(12)]
    table = records(spark, rows).withColumn("source", F.when(F.col("rec_id") < 4, "site-a").otherwise("site-b"))
    assert mainbody.page_model(table, tuple(SAMPLES))[0]["recurring"] == {"zaphod beeblebrox"}
    monkeypatch.setattr(mainbody, "PAGES_SHARE", 0.5)  # on too few of all pages
    model, per_page = mainbody.page_model(table, tuple(SAMPLES))
    assert not model["recurring"] and {(r.page, *r["keys"]) for r in per_page.collect()} == {(i, "zaphod beeblebrox") for i in range(4)}
    got = {tuple(r) for r in mainbody.lines_outside(table, sample_table(spark)).collect()}
    assert {(i, 1) for i in range(4)} <= got


def test_residue(spark):
    nouns = ["wave", "node", "charge", "graph", "heat", "mass", "field", "flux"]
    names = ["title", "author", "topic", "date"]
    docs = []
    for i in range(60):
        words = " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + (i * 7 + j) % 26)}" for j in range(110))
        docs.append((i, f"The {nouns[i % 8]} of the {nouns[(i + 3) % 8]} grows slowly. {words}. We call a page gone when the {nouns[i % 8]} ends."))
    for i in range(60, 84):
        a, b = names[i % 4], names[(i + 1 + i // 4) % 4]
        docs.append((i, f"Welcome to {{{{{a}}}}}, a lesson by {{{{{b}}}}}. The {nouns[i % 8]} grows slowly."))
    for i in range(84, 100):
        docs.append((i, ["Access denied. Code {}.", "Please activate scripts to continue. {}", "Access denied.\nPlease try again later. {}", "Loading scripts {}\nPlease activate scripts to continue."][i % 4].format(i)))
    docs += [(100 + i, f"The template language marks a slot as {{{{title}}}} and fills it. " + docs[i][1]) for i in range(6)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "Please activate scripts to continue.\n" + docs[5][1]), (204, docs[84][1]), (205, "{{" * 500 + "x" * 100_000)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n int")
    got = {r.doc_id for r in residue.residue_documents(rows).collect()}
    assert got == {*range(60, 100), 204}
    assert residue.residue_documents(rows.limit(0)).count() == 0


def reasons(spark, docs):
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    out = [set() for _ in docs]
    for r in residue.residue_reasons(rows).collect():
        out[r.doc_id].add(r.reason)
    return out


def test_slots_left_alike_on_many_pages(spark):
    docs = [f"Lesson {'abcdefgh'[i]} is ready. Welcome back dear {{{{name}}}} your notes are here." for i in range(6)]  # one place, one name
    docs += ["Written for {{name}} by {{date}} today.", "Written for {{date}} by {{name}} today."]
    quoted = ["The template language marks a slot as {{name}} and fills it.", "Write `{{name}}` and it is filled in later.", "In LaTeX one writes \\frac{{a}}{{b}} for it.", "def f(x): return {'node': x, 'edge': [x]}"]
    assert ["slot" in r for r in reasons(spark, docs + quoted)] == [True] * 8 + [False] * 4


def test_slots_that_occur_once(spark):
    docs = ["Without the notion of {имя} it cannot be said.", "Por <tema>, <autor> aquí la red queda.", "Resumen: {{ page.fecha | default }}\n", "By «tema» it is.", "He said «nothing» and <br> left [sic]."]
    assert ["slot" in r for r in reasons(spark, docs)] == [True, True, True, True, False]


def test_defaults_and_blanks_at_aligned_slots(spark):
    filled = [f"The lesson on {x} was held by {y} in the old hall of the town, where {z} grew." for x, y, z in (("waves", "Brisko", "grass"), ("heat", "Anna Quorrin", "moss"), ("slow light", "Ostmere", "ivy"))]
    left = ["The lesson on TBD was held by Halvane in the old hall.", "The lesson on waves was held by ____ in the old hall.", "The lesson on heat was held by [ ] in the old hall.", "The lesson on %topic% was held by %author% in the old hall."]
    other = ["He wrote ____ on the wall and null in the log.", "A call to f() and an empty list [] are code.", "They said n/a twice."]
    got = reasons(spark, filled + left + other)
    assert [r & {"slot", "default", "blank"} for r in got] == [set()] * 3 + [{"default"}, {"blank"}, {"blank"}, {"slot"}] + [set()] * 3


def test_page_templates_by_repeated_pages(spark):
    nouns = ["wave", "node", "charge", "graph", "heat", "mass", "field", "flux"]
    rich = [" ".join(f"The {nouns[(i + j) % 8]} w{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)} of the {nouns[(i * j) % 8]} q{chr(97 + (i * 7 + j) % 26)}z grows." for j in range(70)) for i in range(20)]
    pages = [f"Zork failure 5{i}a at the relay.\nPlease knock again later." for i in range(3)] + ["A title of it\nZork failure 77 at the relay."]
    got = reasons(spark, rich + pages + ["A short wave grows."])
    assert ["page" in r for r in got] == [False] * 20 + [True] * 4 + [False]


def test_a_file_with_most_records_is_dealt_out(spark, monkeypatch):
    from mycelia.llm import pages

    rows = [(i, "big.html", "en", f"line {i}", None) for i in range(400)] + [(1000 + i, f"p{i % 7}.html", "en", "x", None) for i in range(30)]
    table = records(spark, rows + rows[:5])
    each = pages.by_file(lambda recs: [(len(recs), min(r[0] for r in recs))], ["n", "first"])
    assert sorted(r.n for r in pages.file_rows(table, ".html").mapInPandas(each, "n int, first bigint").collect()) == [4, 4, 4, 4, 4, 5, 5, 400]
    monkeypatch.setattr(pages, "STRETCH", 100)
    monkeypatch.setattr(pages, "OVERLAP", 10)
    got = pages.file_rows(table, ".html").mapInPandas(each, "n int, first bigint").collect()
    assert sum(r.n for r in got) == 430 and max(r.n for r in got) == 100
    keyed = pages.by_file(lambda recs: [(r[0], len(recs)) for r in recs], ["rec_id", "n"])
    rows = pages.file_rows(table, ".html").mapInPandas(keyed, "rec_id bigint, n int").where("rec_id < 400").collect()
    assert sorted(r.rec_id for r in rows) == list(range(400)) and {r.n for r in rows} == {110, 120}


def test_assembling():
    lines = [("Kопия", False, False, {}), ("", False, False, {}), ("One exa-", False, True, {}), ("- 5 -", True, False, {}), ("mple of thc", False, False, {"thc": "the"}), ("well-", False, False, {}), ("known", False, False, {}), ("", False, False, {}), ("", False, False, {})]
    assert scans.assemble(lines) == ["Kопия", "One example of the well-known"]
    assert scans.assemble([("It ends.", False, False, {}), ("2.1 Mass", False, False, {}), ("It be-", False, True, {}), ("gins.", False, False, {})]) == ["It ends.", "2.1 Mass", "It begins."]
    assert scans.straightened("на3ывали") == "называли" and scans.straightened("bound@ry") == "boundary" and scans.assemble([]) == []
