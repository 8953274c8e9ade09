import random

import pytest

from lumenar.llm import alignment
from lumenar.llm.alignment import align_sentences, sentences, words

# a small made-up language pair: word by word, with the adjective after the noun
WHO = {"the pilot": "el piloto", "the teacher": "la maestra", "the museum": "el museo", "the guard": "la guardia", "the choir": "el coro", "the editor": "el redactor"}
DID = {"found": "encontro", "lost": "perdio", "copied": "copio", "signed": "firmo", "hid": "oculto", "sold": "vendio"}
WHAT = {"the old map": "el mapa viejo", "the red boat": "el barco rojo", "the long letter": "la carta larga", "the new song": "la cancion nueva", "the safe house": "la casa segura"}
WHERE = {"on monday": "el lunes", "at noon": "al mediodia", "last night": "anoche", "without notice": "sin aviso"}


def sentence(rnd):
    parts = [rnd.choice(list(x.items())) for x in (WHO, DID, WHAT, WHERE)]
    return " ".join(p[0] for p in parts).capitalize(), " ".join(p[1] for p in parts).capitalize()


def document(rnd):
    pairs = []
    while len(pairs) < rnd.randint(2, 7):
        p = sentence(rnd)
        if p not in pairs:
            pairs.append(p)
    source = [p[0] for p in pairs]
    order = list(range(len(pairs)))
    links = []
    if rnd.random() < 0.3:
        rnd.shuffle(order)
    if len(order) > 2 and rnd.random() < 0.4:
        order.remove(rnd.choice(order))
    target, k = [], 0
    while k < len(order):
        if k + 1 < len(order) and rnd.random() < 0.2:
            target.append(f"{pairs[order[k]][1]}, y {pairs[order[k + 1]][1].lower()}")
            links += [(order[k], len(target) - 1), (order[k + 1], len(target) - 1)]
            k += 2
        else:
            target.append(pairs[order[k]][1])
            links.append((order[k], len(target) - 1))
            k += 1
    return " ".join(s + rnd.choice(".!?") for s in source), "\n".join(t + "." for t in target), links


def test_held_out_accuracy(spark):
    rnd = random.Random(7)
    docs = [document(rnd) for _ in range(300)]
    rows = [(i, "x", s, t) for i, (s, t, _) in enumerate(docs)] + [(900, "x", None, "a."), (901, "x", "a.", None), (902, "x", "", ""), (903, "x", "...", "!!!"), (None, "x", "a.", "b."), (904, "x", "Word " * 3000 + ".", "Palabra " * 3000 + ".")]
    found = align_sentences(spark.createDataFrame(rows, "id bigint, lang string, source string, target string")).collect()
    got = {(r.id, r.source_idx, r.target_idx) for r in found}
    want = {(i, a, b) for i, (_, _, links) in enumerate(docs) for a, b in links}
    assert not {g for g in got if g[0] > 899 and g[0] != 904}
    got = {g for g in got if g[0] < 900}
    hits = len(got & want)
    assert hits / len(got) > 0.95 and hits / len(want) > 0.95, (hits, len(got), len(want))


def test_pieces():
    assert sentences("  One two. Three?  Four!\n\nFive... 3.5 six ") == ["One two.", "Three?", "Four!", "Five...", "3.5 six"]
    assert sentences(None) == [] and sentences(" ") == []
    assert words("Ｍás de 2.481 ΝIÑOS (13,5)") == ["mas", "de", "2481", "ninos", "13", "5"]


def test_empty(spark):
    assert align_sentences(spark.createDataFrame([], "id bigint, lang string, source string, target string")).count() == 0


SCHEMA = "id bigint, lang string, source string, target string"


def _trained(spark, n=60):
    """Documents as Arrow batches, and tables trained on them as the workers see them."""
    rnd = random.Random(11)
    rows = [(i, "x" if i % 7 else None, *document(rnd)[:2]) for i in range(n)] + [(n, "x", "One. Two two two. Three", "dos dos. tres"), (n + 1, "x", "", "uno."), (n + 2, "x", "Same same.", "Same same. Same.")]
    docs = alignment.tokenise_documents(spark.createDataFrame(rows, SCHEMA))
    trained = alignment.train_lexicon(docs)
    return docs.toArrow().combine_chunks().to_batches(), alignment._lexicon(trained.weights.toPandas(), trained.table.toPandas(), trained.rare_weight)


def _linked(batches, lexicon):
    found = [r for b in alignment._link_batches(lambda _: lexicon)(iter(batches)) for r in b.to_pylist()]
    return sorted((r["id"], r["lang"] or "", r["source_idx"], r["target_idx"], round(r["score"], 9)) for r in found)


def test_large_documents_go_in_pieces(spark, monkeypatch):
    """The same links whether many documents are worked on together or a sentence of one at a time."""
    batches, lexicon = _trained(spark)
    together = _linked(batches, lexicon)
    counted = [[x.tolist() for x in alignment._uniform(alignment.Batch(b, lexicon), False)] for b in batches]
    monkeypatch.setattr(alignment, "CELLS", 40)
    assert together and _linked(batches, lexicon) == together
    for one, other in zip(counted, [[x.tolist() for x in alignment._uniform(alignment.Batch(b, lexicon), False)] for b in batches]):
        assert one[0] == other[0] and one[1] == pytest.approx(other[1]) and one[2] == other[2]


def test_links_are_those_of_one_at_a_time(spark):
    """Accepting pairs together gives what accepting the best pair of a document, one after another, gives."""
    batches, lexicon = _trained(spark)
    want = []
    for record in batches:
        batch = alignment.Batch(record, lexicon)
        strength = {(a, b): x for a in range(batch.code.size) for b, x in zip(batch.column[batch.row_start[a] : batch.row_start[a + 1]].tolist(), batch.strength[batch.row_start[a] : batch.row_start[a + 1]].tolist())}
        for d, row in enumerate(record.to_pylist()):
            want += [(row["id"], row["lang"] or "", i, j, round(x, 9)) for i, j, x in _one_at_a_time(batch, d, strength)]
    assert _linked(batches, lexicon) == sorted(want)


def _one_at_a_time(batch, d, strength):
    sides = []
    for side, ids in ((batch.s, batch.s_id), (batch.t, batch.t_id)):
        first, last = side.first_sentence[d], side.first_sentence[d + 1]
        sides.append([[[int(ids[w]), int(side.code[w]), int(side.count[w])] for w in range(side.first_word[k], side.first_word[k + 1])] for k in range(first, last)])
    s, t = sides
    spelt = {w[1] for x in s for w in x} & {w[1] for x in t for w in x if w[1] & 1}
    weight = lambda known, weights, w: weights[w[0]] * (1.0 if known[w[0]] or w[1] in spelt else alignment.LONE_RARE)
    ws = [[weight(batch.s_known, batch.s_weight, w) for w in x] for x in s]
    wt = [[weight(batch.t_known, batch.t_weight, w) for w in x] for x in t]
    s_left, t_left = [[w[2] for w in x] for x in s], [[w[2] for w in x] for x in t]
    s_words, t_words = sum(map(sum, s_left)), sum(map(sum, t_left))
    s_long, t_long = [sum(x) for x in s_left], [sum(x) for x in t_left]

    def match(a, b):
        return 1.0 if a[1] == b[1] and a[1] & 1 else strength.get((a[0], b[0]), 0.0)

    def score(i, j):
        m = [[match(a, b) * (s_left[i][x] > 0) * (t_left[j][y] > 0) for y, b in enumerate(t[j])] for x, a in enumerate(s[i])]
        rows, columns = [max(r, default=0) for r in m], [max(c) for c in zip(*m)]
        cs = sum(r * w * n for r, w, n in zip(rows, ws[i], s_left[i])) / max(1e-9, sum(w * x[2] for w, x in zip(ws[i], s[i])))
        ct = sum(c * w * n for c, w, n in zip(columns, wt[j], t_left[j])) / max(1e-9, sum(w * x[2] for w, x in zip(wt[j], t[j])))
        return 0.7 * max(cs, ct) + 0.3 * min(cs, ct), rows, columns

    left = {(i, j) for i in range(len(s)) for j in range(len(t)) if s[i] and t[j]}
    while left:
        scored = {p: score(*p) for p in left}
        left = {p for p in left if scored[p][0] >= alignment.LINK_SCORE}
        if not left:
            return
        i, j = min(left, key=lambda p: (1e-3 * abs((p[0] + 0.5) / len(s) - (p[1] + 0.5) / len(t)) - scored[p][0], p))
        value, rows, columns = scored[i, j]
        yield i, j, value
        left.discard((i, j))
        expected = s_long[i] * t_words / s_words
        long_t = t_long[j] > alignment.MERGED * expected
        long_s = not long_t and expected > alignment.MERGED * t_long[j]
        for best, held, halved in ((rows, s_left[i], long_s), (columns, t_left[j], long_t)):
            for k, x in enumerate(best):
                if x >= alignment.USED_MATCH:
                    held[k] = held[k] // 2 if halved else 0


def test_joined_tables_give_what_broadcast_tables_give(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, "x" if i % 5 else None, *document(rnd)[:2]) for i in range(80)] + [(3, "x", "The pilot hid.", "El piloto oculto.")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, align_sentences(df).collect()), key=repr)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", -1)
    other = sorted(map(tuple, align_sentences(df).collect()), key=repr)
    assert [r[:4] for r in one] == [r[:4] for r in other] and [r[4] for r in one] == pytest.approx([r[4] for r in other])


def test_the_driver_holds_a_piece_of_the_tables_at_a_time(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, "x" if i % 5 else None, *document(rnd)[:2]) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, align_sentences(df).collect()), key=repr)
    sizes, share = [], spark.sparkContext.broadcast

    def broadcast(x):
        if isinstance(x, alignment.Lexicon):
            sizes.append(x.source.size + x.target.size + x.pair_source.size)
        return share(x)

    def gathered(*_):
        raise AssertionError("all rows gathered in the driver")

    monkeypatch.setattr(alignment, "PIECE", 40, raising=False)
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    with monkeypatch.context() as patch:
        for name in ("toPandas", "toArrow"):
            patch.setattr(type(df), name, gathered)
        links = alignment.align_sentences(df)
    assert whole and sorted(map(tuple, links.collect()), key=repr) == whole
    assert len(sizes) > 10 and max(sizes) <= 40 and max(sizes) > min(sizes) > 0


def test_words_of_batches_are_those_of_single_sentences():
    texts = ["One two, two!  Three 2.481 four\u2003five? six.", "", " ... ", "No end", "¿Qué?\nＭás ｄe 3,5 (x)... y", "a\u200bb. Ζ"]
    sizes, codes, counts = alignment._words_of(texts, alignment._Chunks(alignment.canonical))
    for text, n, code, count in zip(texts, sizes.to_pylist(), codes.to_pylist(), counts.to_pylist()):
        parts = [words(x) for x in sentences(text)]
        assert n == [len(set(x)) for x in parts]
        assert sorted(count) == sorted(x.count(w) for x in parts for w in set(x)) and len(code) == len(count)
