import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from legajo.llm import encoding, quality, sentences, terms


# --- sentences ---
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("El Dr. Bandorno firmó. La Sra. Pelsuna y el Ing. Q. Ostolva no.", 2),
        ("El equipo llegó de EE. UU. con la red. Tiene domicilio en EE. UU. La obra quedó a cargo de Rara S.A. El acta se cerró a las 4 p. m. Fin.", 5),
        ("La firma Difi S.A.S. recibió 1.234,5 kg y 12.5 m. Véase la pág. 6 del art. 3.", 2),
        ("Según el informe, \"La copia se perdió. El archivo está vacío.\" y así consta. Se acabó.", 2),
        ("El director respondió: «la Secretaría negó.» El control siguió.", 2),
        ("(Véase el anexo.) La Ley 3 rige. ¿Y los convenios?! No hay.", 4),
        ("Hubo tres versiones (la primera, ¡sin firma!, se anuló) y la obra siguió… pero sellos, firmas... y nada.", 1),
        ("—No hay recibo —dijo el tesorero—, pero el plan siguió. Es todo.", 2),
        ("El plan —¡qué tarde! ¿quién lo vio?— siguió igual. Fin.", 2),
        ("Esto es parcial.La obra sigue. 1. La Unidad amplió. 2) La red cayó. a) El censo.", 5),
        ("See No. 4, Sec. 4.2, where it was, i.e. the staff, etc. However, Mr. Mos left at 5 p.m. sharp. \"We lost. Nothing else,\" said he.", 3),
        ("Am 3. März 2025 prüfte Herr Dr. Ost z. B. den Plan. „Es fehlt jeder Beleg. Auch der Plan fehlt“, so die Stelle.", 2),
        ("Cf. p. 172 de l'annexe. « Aucun reçu. Aucun plan », note M. Varzolo. Pourquoi la liste ? Le Dr Mos a signé.", 4),
        ("В 2026 г. Комиссия утвердила план. См. стр. 80, п. 4, т. е. список. «Нет акта. Нет сметы», — отметила служба.", 3),
        ("报告写道：“没有收据。没有记录。”水务公司因此取消了。见附件（编号No.52），没有。为什么？", 3),
        ("「領収書はない。記録もない。」と述べた。2020年、監査室は延期した！", 2),
        ("डॉ. मधुरेश ने कहा, “रसीद नहीं है। अभिलेख भी नहीं है।” और गया। सूचकांक 84.5 से 1.8 हो गया।", 2),
        ("قال د. منير: «لا يوجد إيصال. لا يوجد سجل» ثم راجع العقد. ارتفع من 58.4 إلى 25.9. لماذا؟", 3),
        ("ดัชนีเพิ่มจาก 45.3 เป็น 38.4 โดยไม่มีเหตุผล การท่าเรือยกเลิกแบบสะพาน ในปี 2028 กรมทางอนุมัติ", 3),
        ("", 0), ("  \n ", 0), ("...", 1), ("a" * 100_000, 1), ("«sin cierre. Otra. Más", 3),
    ],
)
def test_sentence_counts(text, want):
    starts = sentences.sentence_starts(text)
    assert len(starts) == want, [text[s : s + 25] for s in starts]
    assert starts == sorted(set(starts)) and all(not text[s].isspace() for s in starts)


@pytest.mark.parametrize("size", [20, 60, 6_000])
@pytest.mark.parametrize("marks", ["«»", "“”", '""', "()", "——"])
def test_spans_of_any_length_end_no_sentence(marks, size):
    inside = " ".join(["Se perdió el acta."] * size)
    text = f"El jefe dijo {marks[0]}{inside}{marks[1]}, y el plan siguió. Es todo."
    assert [text[s : s + 5] for s in sentences.sentence_starts(text)] == ["El je", "Es to"]


def test_stray_marks_are_read_in_linear_time():
    text = "(«“ —a " * 40_000 + "Fin. Otra."
    assert len(sentences.sentence_starts(text)) == 2


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("គណៈកម្មាធិការបានអនុម័ត។ របាយការណ៍ត្រូវបានផ្ញើ។ គ្មានកំណត់ត្រាទេ។", 3),
        ("ກົມທາງຍົກເລີກສັນຍາໂດຍບໍ່ມີເຫດຜົນ ການທ່າເຮືອອະນຸມັດແຜນ ໃນປີ 2028 ກະຊວງເລື່ອນ", 3),
        ("审计办公室批准了报告了 水务公司遗失了合同吗 采购委员会取消了", 3),
        ("監査室は契約を承認した 水道公社は報告書を取り消した 記録はない", 3),
        ("審査 記録。次の文。", 2),
        ("ရုံးက အတည်ပြုသည်။ မှတ်တမ်းမရှိပါ။", 2),
        ("አንድ ዓረፍተ ነገር። ሁለተኛ።", 2),
    ],
)
def test_scripts_without_blanks_or_stops(text, want):
    starts = sentences.sentence_starts(text)
    assert len(starts) == want, [text[s : s + 25] for s in starts]


def test_sentence_table(spark):
    rows = [("p", "Uno. Dos.", "body"), ("p", "Uno. Dos.", "body"), ("h", "I. Los títulos. Otra", "heading"), ("n", None, None), (None, " Tres. ", None)]
    df = spark.createDataFrame(rows, "paragraph_id string, clean_text string, block_type string")
    causal = spark.createDataFrame([], "sentence_id string, text string")
    got = {(r["rec_id"], r["sent_no"], r["start_pos"]) for r in sentences.sentence_units(df, causal).collect()}
    assert got == {("p", 1, 0), ("p", 2, 5), ("h", 1, 0), (None, 1, 1)}


def test_garbled_text_is_told_as_it_stands(spark):
    good = "没有收据。没有记录。"
    bad = good.encode().decode("latin-1")
    mended, offsets = encoding.aligned_restore(bad)
    assert mended == good and [offsets[s] for s in sentences.sentence_starts(mended)] == [0, 15]


# --- encodings ---
WORDS = ["inversión", "Auditoría", "según", "«Los", "respondió»,", "Prüfstelle", "l'œuvre", "São", "manutenção", "¿Qué", "договор", "记录没有", "किया।", "REGIÃO", "über", "ñandú", "été", "–", "técnico-jurídico"]


@pytest.mark.parametrize("word", WORDS)
def test_right_words_stay(word):
    assert encoding.restored_word(word) == (word, False)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("word", ["inversión", "Auditoría", "según", "Prüfstelle", "manutenção", "договор", "记录没有"])
def test_utf8_read_wrongly(codec, word):
    bad = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in word.encode())
    assert encoding.restored_word(bad) == (word, True)


#: Accents, Cyrillic, Han and Kana: the words that one to four garblings by each mapping must not lose.
GARBLED = (
    "inversión Auditoría según respondió Prüfstelle manutenção niño señala Tesorería año público técnico jurídico Áreas Éxito Índice Única "
    "pingüino vergüenza corazón también después jamás fácil difícil débil árbol cárcel dólar lápiz mártir fértil césped huésped álbum acción gestión "
    "región unión avión camión millón corrupción construcción España mañana pequeño montaña campaña dueño otoño sueño baño caña leña seña ñandú peña "
    "piña riña viña élève après très où reçu façade garçon leçon français août forêt hôpital fenêtre même fête tête bête château pâte tâche rôle "
    "côté dépôt impôt bientôt naïf maïs haïr Noël cœur sœur bœuf über für Tür Müller Köln schön Straße weiß heiß Fuß Gruß Mädchen Käse spät não São "
    "ação coração irmã maçã também você avô avó três mês pêssego cinquenta договор комиссия проверка служба акт смета Россия Москва бюджет закон "
    "решение область район город совет ревизия подпись документ объект 记录没有 审计办公室 批准了 预付款 水务公司 道路工程局 公开招标 監査室は "
    "契約を取り消した ない。 文書館 報告書 财政承担 结算报告 设备清单"
).split()


@pytest.mark.parametrize("times", [1, 2, 3, 4])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_garbled_again_and_again(codec, times):
    signs = {b: chr(point) for point, b in encoding._byte_of(codec).items()}
    wrong = []
    for word in GARBLED:
        bad = word
        for _ in range(times):
            bad = "".join(signs[b] for b in bad.encode())
        if encoding.restored_word(bad)[0] != word:
            wrong.append((word, encoding.restored_word(bad)[0]))
    assert not wrong


def full_search(word: str) -> float:
    """The least cost of all texts that can be reached, without any bound."""
    best, todo, seen = encoding.implausibility(word), [(word, False, 0)], {}
    while todo:
        text, changed, depth = todo.pop()
        if seen.get((text, changed), 99) <= depth:
            continue
        seen[(text, changed)] = depth
        best = min(best, encoding.implausibility(text) + encoding.STEP * depth)
        todo += [(t, c, depth + 1) for t, c in encoding.neighbours(text, changed) if t != text]
    return best


@pytest.mark.parametrize("word", ["ComisiÃƒÂ³n", "AuditorÝa", "ïîòåðÿëà", "Âà•Á¥ô", "reÃƒÂ§u.", "¬å\x8f¸å¤\x8dæ", "PrÃ¼fstelle&ntilde;", "¶§Ærn", "Straﬂe"])
def test_search_is_exact(word):
    found, changed = encoding.restored_word(word)
    least = full_search(word)
    assert changed == (least < encoding.implausibility(word) - encoding.GAIN - 1e-9)
    if changed:
        assert encoding.implausibility(found) <= least


def test_plain_texts_hold_no_garbled_word():
    signs = sorted(encoding._CLEAR - set(" \t\r\n"))
    for a in signs:
        for b in signs:
            for word in (f"{a}{b}", f"so{a}{b}a", f"So{a}a{b}l"):
                assert encoding.restored_word(word) == (word, False)


def test_twice_and_single_byte():
    assert encoding.restored_word("ComisiÃƒÂ³n")[0] == "Comisión"
    assert encoding.restored_word("AuditorÝa")[0] == "Auditoría" and encoding.restored_word("autorizÛ")[0] == "autorizó"
    assert encoding.restored_word("ïîòåðÿëà")[0] == "потеряла"


def test_lost_marks_and_misreadings():
    assert encoding.restore("El avance f?sico sigue")[1:] == (True, False)
    assert encoding.restore("entreg� los")[1:] == (True, False)
    assert encoding.restore("Direcci\x0en", {"\x0e": "ó"}) == ("Dirección", True, True)
    for clean in ("¿Quién aprobó el censo? a) La Junta.", "el puente peªtonal de Hosþital", "el presu¬\npuesto", "«Não há», disse", "a 110 ‰ de 3 m²"):
        assert encoding.restore(clean)[1] is False, clean


def test_garbled_tables(spark):
    p = spark.createDataFrame([("a", "La AuditorÃ\xada"), ("a", "La AuditorÃ\xada"), ("b", "La Auditoría"), ("c", None), ("d", "")], "paragraph_id string, clean_text string")
    schema = (
        "document_id string, page_number int, blocks array<struct<block_id:int,lines:array<struct<text:string>>>>, repair_log array<struct<block_id:int,original_text:string,ocr_text:string>>"
    )
    pages = spark.createDataFrame(
        [("D", 1, [(0, [("bien",), ("quedÃ³",)]), (1, [(None,)]), (2, [])], [(4, "raz\x0en", "razón")]), ("D", 2, None, None), (None, None, [(0, [("nÃ³mina",)])], [])], schema
    )
    sources = encoding.garbled_sources(p, pages)
    assert {tuple(r) for r in encoding.garbled_records(sources).collect()} == {("paragraphs", "a"), ("blocks", "D/1/0"), ("repair_log", "D/1/4"), ("blocks", "//0")}
    glyphs = encoding.glyph_map(pages)
    assert glyphs == {"\x0e": "ó"}
    assert {r["restored"] for r in encoding.repaired(sources, glyphs).collect()} == {"La Auditoría", "quedó", "razón", "nómina"}
    assert encoding.garbled_records(encoding.garbled_sources(p.limit(0), pages.limit(0))).count() == 0


# --- quality ---
KINDS = {
    "list": ["Lista de bienes:\n- el plan\n- la red\n- el censo\n- la obra", "1) uno\n2) dos\n3) tres\n4) cuatro", "El plan .... 3\nLa red ........ 6\nEl censo ...... 9", "el plan\nLa red;\nel censo\nJolvera, D."],
    "table": ["| a | 1 | 2 |\n| b | 3 | 4 |\n| c |  | 5 |", "Concepto;Valor;Año\nplan;1;2\nred;3;4", "el plan        12   45\nla red         3    9\nel censo       77", "plan\t1\t2\nred\t3\t\ncenso\t5\t6"],
    "junk": ["========" * 9, "ver más " * 30, "lhehhirlp qave yvmrrmgc bmyk xhaslc lnssbgh zzvv", "82 94 c3 44 44 44 05 ff 85 0b", "□?�Ã€�■" * 9 + "¢€", "ZEVrEZnf21BeycAUJjeQV3Yf1iOwMdc+KF7ZaNvj303NN"],
    None: ["", None, " \n ", "Esto es parcial.", "EL FONDO DE VIVIENDA NEGÓ LA OBRA EN LA ZONA COSTERA Y LA RED CAYÓ", "La red quedó.\n\n- el plan\n- la obra\n\nEl Fondo de Vivienda aprobó la obra sin soporte documental en la zona costera durante el primer semestre.", "港口管理处推迟了预付款；道路工程局未作说明！\n指数从37.6升至12.8。\n2029年，港口管理处批准了。"],
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kinds(kind, text):
    assert quality.kind_of(text) == kind


def test_layout_figures():
    assert quality.length_autocorrelation([5, 5, 5]) == 1 and quality.length_autocorrelation([1, 9] * 10) < -0.8
    assert quality.indentation_period(["- a", "  b", "- c", "  d", "- e", "  f"]) == (2, 1.0) and quality.indentation_period(["a", "b"]) == (0, 0.0)


def test_repetition_after_a_beginning():
    assert quality.kind_of("Aviso legal 7: " + "consulte el portal de la entidad " * 40) == "junk"
    assert quality.periodic("ver más " * 5) and not quality.periodic("ver más " * 4) and not quality.periodic("abc" * 3 + "El plan siguió y la obra quedó sin firma alguna.")


#: Cases that one signal decides: items of which half the lines go on without a mark, rows among notes in the order of their
#: lengths, and a text of few vowels with many common words.
WRAPPED_ITEMS = "\n".join(f"- el plan {i} de la red\nde agua y censo" for i in range(9))
ROWS_AND_NOTES = sorted([f"plan {'x' * (3 * i % 11)};{i};{i * 7}" for i in range(8)] + ["nota " + "y" * (2 * j) for j in range(3)], key=len)
FEW_VOWELS = "prstl krkvl la de en un vlkst el " * 3


def test_each_signal_changes_answers(monkeypatch):
    assert quality.kind_of(WRAPPED_ITEMS) == "list"
    with monkeypatch.context() as m:
        m.setattr(quality, "indentation_period", lambda lines, longest=4: (0, 0.0))
        m.setattr(quality, "brief_kind", lambda lines: None)
        assert quality.kind_of(WRAPPED_ITEMS) is None
    assert quality.rows_kind(ROWS_AND_NOTES) == "table"
    with monkeypatch.context() as m:
        m.setattr(quality, "length_autocorrelation", lambda lengths, lag=1: 0.0)
        assert quality.rows_kind(ROWS_AND_NOTES) is None
    assert not quality.is_noise(FEW_VOWELS, [FEW_VOWELS])
    with monkeypatch.context() as m:
        m.setattr(quality, "W_COMMON", 0.0)
        assert quality.is_noise(FEW_VOWELS, [FEW_VOWELS])
    with monkeypatch.context() as m:
        m.setattr(quality, "delimiter_alignment", lambda lines: (0.0, "", []))
        assert all(quality.rows_kind(t.split("\n")) is None for t in KINDS["table"])


def test_statistics_of_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Uno dos.\nTres!")], "doc_id int, text string").withColumn("n_words", F.lit("clash"))
    rows = {r["doc_id"]: r for r in quality.document_statistics(df).collect()}
    assert rows[1]["n_words"] is None and rows[2]["n_words"] == 0 and rows[2]["letter_ratio"] is None
    assert (rows[3]["n_words"], rows[3]["n_lines"], rows[3]["lines_ending_in_punctuation"]) == (3, 2, 1.0)


# --- terms ---
def test_scores_match_brute_force(spark):
    texts = {"a": "casa casa Zafiro zafiro zafiro único", "b": "casa perro casa", "c": "casa gato zafiro", "d": None, "e": "123"}
    df = spark.createDataFrame([*texts.items(), ("a", texts["a"])], "k string, t string")
    probes = spark.createDataFrame([("a",), ("a",), ("d",), ("zz",)], "k string")
    scores = {r["term"]: r["score"] for r in terms.term_scores(df, probes, "k", "t").collect()}
    counts = {k: Counter(w for w in (t or "").lower().split() if w.isalpha()) for k, t in texts.items()}
    total = sum(counts.values(), Counter())
    size, n = sum(total.values()), sum(counts["a"].values())
    for w, o in counts["a"].items():
        e = n * (total[w] + terms.COLUMN_PRIOR) / size
        assert scores[w] == pytest.approx((o - e) / math.sqrt(e * (1 - n / size) * (1 - total[w] / size)))
    best = terms.most_characteristic(terms.term_scores(df, probes, "k", "t"), "k").collect()
    assert [(r["k"], r["term"]) for r in best] == [("a", "zafiro")]
    assert terms.term_scores(df.limit(0), probes, "k", "t").count() == 0


def test_texts_that_the_search_restores_are_suspect(spark):
    made = {"Baugenehmigungsbehˆrde": "Baugenehmigungsbehörde", "Verg¸tung": "Vergütung", "M‰rz": "März", "pßgina": "página", "tΘcnico": "técnico", "autonomφa": "autonomía"}
    for w, right in made.items():
        assert encoding.restored_word(w) == (right, True)
    words = ["página", "técnico", "autonomía", "gestión", "según", "compañía", "Vergütung", "Behörde", "März", "ÍNDICE", "señal", "français", "São"]
    for w in words:
        for codec in encoding.UTF8_READ_BY:
            made["".join({b: chr(p) for p, b in encoding._byte_of(codec).items()}[b] for b in w.encode())] = w
        for read_by, written_by in encoding.SINGLE_BYTE:
            if written_by != "cp1251":
                made["".join({b: chr(p) for p, b in encoding._byte_of(read_by).items()}[b] for b in w.encode(written_by, "ignore"))] = w
    garbled = [(w,) for w in made if encoding.restored_word(w)[1]]
    assert len(garbled) > 80
    assert spark.createDataFrame(garbled, "t string").where(~encoding.suspect(F.col("t"))).collect() == []
    plain = [("Straße, Größe, d’or, 5‰ y 3 €; «año» — compañía… lingüística",)]
    assert spark.createDataFrame(plain, "t string").where(encoding.suspect(F.col("t"))).collect() == []
    assert not any(encoding.restored_word(w)[1] for w in ("Straße", "d’or", "5‰", "€", "compañía"))
