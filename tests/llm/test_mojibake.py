from lumenar.llm.mojibake import garbled_documents, garbled_forms, read_as, restore_documents, write_in

CLEAN = ["A canção da estação não é só emoção.", "El niño cantó en Jundução, según José.", "“More” — it’s the café…", "αρχείο ήχου, ταινία", "архів записів", "──── ■ §4 «acta» nº 12", "plain ascii only"]


def garble(text, written, read):
    data = text.encode("utf-8") if written == "utf-8" else write_in(text, written)
    return data.decode("utf-8", "replace") if read == "utf-8" else read_as(data, read)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_finds_and_restores(spark):
    chains = [("utf-8", c) for c in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")] + [("cp1252", c) for c in ("mac_roman", "cp850", "cp1251", "utf-8")]
    bad = [(garble(CLEAN[0], *c), CLEAN[0]) for c in chains] + [(garble(garble(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[1]), (garble(CLEAN[2], "utf-8", "cp1252"), CLEAN[2]), (garble(CLEAN[3], "utf-8", "cp1252"), CLEAN[3])]
    texts = CLEAN * 30 + [None, "", "   "] + [b for b, _ in bad]
    found = {r.doc_id: r.restored for r in restore_documents(table(spark, texts)).collect()}
    start = len(texts) - len(bad)
    assert set(found) == set(range(start, len(texts)))
    assert [found[start + i] for i in range(len(bad))] == [want for _, want in bad]


def test_stretch_and_unknown_word(spark):
    texts = ["tudo está bem, é só isso ã"] * 5 + ["tudo bem. Zantanã disse: tudo estÃ¡ bem", "Kelbião nunca visto: KelbiÃ£o"]
    texts[-1] = "QuelbiÃ£o nunca visto"  # the word is nowhere clean, its sequence is
    found = {r.doc_id: r.restored for r in restore_documents(table(spark, texts)).collect()}
    assert found == {5: "tudo bem. Zantanã disse: tudo está bem", 6: "Quelbião nunca visto"}


def test_nothing_to_do(spark):
    assert garbled_documents(table(spark, CLEAN * 3)).count() == 0
    assert garbled_documents(table(spark, []).limit(0)).count() == 0
    assert garbled_documents(table(spark, [None, ""])).count() == 0
    clash = spark.createDataFrame([(1, "estÃ¡ está", "x"), (2, "está", "y")], "doc_id bigint, text string, word string")
    assert [r.doc_id for r in garbled_documents(clash).collect()] == [1]


def test_forms():
    forms = garbled_forms("ção")
    assert forms["Ã§Ã£o"] is True and forms["Á„o"] is False and "ção" not in forms
    assert garbled_forms("abc") == {} and garbled_forms("can├º├úo", None).get("canção") is None
    twice = garble(garble("coração", "utf-8", "iso8859-2"), "utf-8", "iso8859-2")
    assert garbled_forms("coração")[twice] is True and len(garbled_forms("coração")) > 100
    assert set(garbled_forms("coração", "Ã§£")) == {"coraÃ§Ã£o"}


def test_a_single_sign_may_stand_for_itself(spark):
    assert garbled_documents(table(spark, ["vou à praia à noite"] * 9 + ["wait … for it"])).count() == 0


def test_copies_of_a_garbled_text_do_not_outvote_it(spark):
    clean = [f"{i}: a canção da estação não é só emoção" for i in range(8)]
    bad = garble("garbled: a canção da estação não é só emoção", "cp1252", "mac_roman")
    texts = clean + [bad] * 40
    found = {r.doc_id: r.restored for r in restore_documents(table(spark, texts)).collect()}
    assert found == {8 + i: "garbled: a canção da estação não é só emoção" for i in range(40)}
