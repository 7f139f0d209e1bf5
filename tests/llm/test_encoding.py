import random
from collections import Counter

import pytest

from quernel.llm import encoding as E

CLEAN = [
    "// Größe der Öffnung später prüfen", 'raise ValueError("clé déjà reçue à côté de la forêt")', "# значение ключ ошибка загрузка", "print('żółć źródło błąd później')", "/* příliš žlutý kůň */", "σφάλμα αρχείο κλειδί", "错误 检查 返回 大小",
    "検索する 結果が 更新", "NÃO SÃO AÇÃO opção", "│   └── Übergabe", "░▒▓ costs", "≤ ∑ α·β", "user’s ±3° “copy” – €5 — naïve café", "ÞAÐ ógilt stærð rétt", "şifre değer çıkış", "în această țară", "después código código señal número código", "forêt à à données", "plain ascii",
]


@pytest.fixture(scope="module")
def model():
    return E.Classifier(Counter(w for line in CLEAN * 30 for w in E._TOKEN.findall(line) if not w.isascii()))


@pytest.mark.parametrize("line", CLEAN)
def test_proper_text_is_left_alone(model, line):
    assert model.repair(line) == ([], line)


CHAINS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("cp1251", "latin-1"), ("koi8_r", "latin-1"),
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1250", "cp1252"), ("iso8859_2", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("gb18030", "latin-1"), ("shift_jis", "cp1252"),
]
PHRASES = ["Größe prüfen später Öffnung", "clé déjà reçue forêt côté", "значение ключ ошибка загрузка", "źródło błąd później ścieżka", "příliš žlutý kůň řádek", "错误检查返回大小索引", "検索する結果が更新行番号", "opção não ação configuração"]


def test_garbled_text_is_found_and_restored(model):
    n = found = restored = 0
    for chain in CHAINS:
        for text in PHRASES:
            made = E.garble(text, chain)
            if made is None or made == text or chain[0] == "gb18030" and not "错" in text or chain[0] == "shift_jis" and "検" not in text:
                continue
            n += 1
            chains, better = model.repair(f'log("{made}", 1)')
            found += bool(chains)
            restored += better == f'log("{text}", 1)'
    assert n > 50 and found == n and restored >= 0.9 * n


def test_a_piece_of_a_line(model):
    chains, better = model.repair("// значение | Ð·Ð½Ð°Ñ‡ÐµÐ½Ð¸Ðµ")
    assert chains and better == "// значение | значение"
    assert model.repair("gar�on fran�ais")[0] == [E.LOST]
    assert model.repair("a" * 50_000 + " naÃ¯ve")[1].endswith("naïve")


def test_accuracy_on_held_out_words(model):
    """Words that the training sample did not hold."""
    words = "Mädchen Äpfel höflich größten fröhlich Käse Schüssel über früher möglich Gebäude Straßenbahn".split()
    wrong = sum(bool(model.repair(w)[0]) for w in words)
    hit = sum(model.repair(E.garble(w, c) or "")[1] == w for w in words for c in CHAINS[:7])
    assert wrong == 0 and hit >= 0.9 * 7 * len(words)


def test_rows(table):
    rng = random.Random(0)
    rows = [(k, rng.choice(CLEAN), "x") for k in range(300)] + [(1000, "wÃ¤hlen GrÃ¶ÃŸe prÃ¼fen", "x"), (1000, "wÃ¤hlen GrÃ¶ÃŸe prÃ¼fen", "x"), (1001, None, "x"), (1002, "", "x"), (1003, "se�al", "x"), (None, "prÃ¼fen", "x")]
    df = table(rows, "id long, body string, restored string", files=3)
    got = {r["key"]: r for r in E.find_garbled(df, "id", "body").collect()}
    assert set(got) == {1000, 1003, None} and got[1000]["restored"] == "wählen Größe prüfen" and got[1000]["is_restored"] and not got[1003]["is_restored"]
    assert E.find_garbled(df.where("false"), "id", "body").count() == 0


def test_any_number_of_pieces(model):
    """More pieces than once were looked for, with proper words between that keep them apart."""
    for n in (9, 60):
        want = " ".join("Größe загрузка öffnung ключ" for _ in range(n))
        made = want.replace("Größe", E.garble("Größe", ("utf-8", "cp1252"))).replace("öffnung", E.garble("öffnung", ("utf-8", "latin-1")))
        chains, better = model.repair(made)
        assert better == want and len(chains) > 8 and not model.suspect(better)


def test_repair_ends_where_chains_undo_each_other(model):
    for text in PHRASES[2:4]:
        made = text
        for chain in (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1250", "cp1252"), ("iso8859_2", "latin-1")):
            made = f"{made} {E.garble(text, chain) or ''} {E.restore(text, chain) or ''}"
        chains, better = model.repair(made * 5)
        assert len(better) <= 5 * len(made) and (chains != []) == (better != made * 5)


def test_rows_with_suspect_rest_are_not_restored(table):
    """The last piece lost a byte within, so that it can't be inverted."""
    rows = [(k, f"{c} {k}", "x") for k in range(40) for c in CLEAN] + [(1000, "wÃ¤hlen GrÃ¶ÃŸe prÃ¼fen", "x"), (1001, "wÃ¤hlen GrÃ¶ÃŸe prÃ¼fen значение ключ ошибка загрузка GrÃ¶ÃŸÃe", "x")]
    got = {r["key"]: r for r in E.find_garbled(table(rows, "id long, body string, restored string"), "id", "body").collect()}
    assert set(got) == {1000, 1001} and got[1000]["is_restored"]
    assert got[1001]["restored"].startswith("wählen Größe prüfen значение") and got[1001]["restored"].endswith("GrÃ¶ÃŸÃe") and not got[1001]["is_restored"]


@pytest.mark.parametrize("word", ["загрузка", "检查返回"])
@pytest.mark.parametrize("between", ["–", "naïve", "é", "café"])
@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "cp1252", "utf-8", "cp1252")])
def test_proper_words_between_garbled_ones(model, word, between, chain):
    """The joined stretch can't be inverted, each garbled word alone can."""
    made = E.garble(word, chain)
    chains, better = model.repair(f"{made} {between} {made}")
    assert chains and better == f"{word} {between} {word}"


def test_long_text_of_garbled_and_proper_words(model):
    made = " ".join([E.garble("загрузка", ("utf-8", "cp1252")), "–"] * 400)
    assert model.repair(made)[1] == " ".join(["загрузка", "–"] * 400)


def test_place_of_failure():
    for chain in (("utf-8", "cp1252"), ("utf-8", "latin-1", "utf-8", "cp1252"), ("gb18030", "latin-1")):
        made = E.garble("错误 检查", chain)
        assert E._fails(made, chain) == len(made) and E._fails(made + " Ω", chain) == len(made) + 1
    assert E._fails("GrÃ¶ÃŸe é x", ("utf-8", "cp1252")) == 8


#: (chain, text) that do not invert: none of these texts.
NOT_INVERTED: set[tuple[tuple[str, ...], str]] = set()


def test_every_chain_is_inverted_exactly():
    texts = [*PHRASES, *E.PHRASES]
    made = {(c, t): E.garble(t, c) for c in E.CHAINS for t in texts}
    assert {c for (c, _), g in made.items() if g is not None} == set(E.CHAINS)
    assert {(c, t) for (c, t), g in made.items() if g is not None and E.restore(g, c) != t} == NOT_INVERTED


def test_training_words(table):
    rows = [(1, "größe größe ok", 1), (2, "größe|später", 2), (3, "größe \ufffd", 3), (4, None, 4), (5, "plain", 5), (6, "ä" * 201, 6)]
    df = table(rows, "id long, body string, word int")
    assert E.training_words(df, "body") == {"größe": 3, "später": 1} and E.training_words(df, "body", 1) == {"größe": 3}
    assert E.training_words(df.where("false"), "body") == {}


def test_a_model_travels(model):
    import pickle

    sent = pickle.loads(pickle.dumps(model))
    line = "// wÃ¤hlen GrÃ¶ÃŸe prÃ¼fen"
    assert sent.repair(line) == model.repair(line) and sent.repair(line)[1] == "// wählen Größe prüfen"


def test_thirty_garbled_words_among_proper_ones(model):
    """Every planted original comes back, and nothing else is changed."""
    rng = random.Random(4)
    proper, lines = [w for line in CLEAN for w in line.split()], []
    for _ in range(20):
        words, want = [], []
        for k in range(60):
            w = rng.choice(proper)
            g = E.garble(w, rng.choice(CHAINS[:2])) if k % 2 and not w.isascii() else w
            words.append(g or w)
            want.append(w)
        lines.append((" ".join(words), " ".join(want)))
    pieces = sum(a != b for made, want in lines for a, b in zip(made.split(" "), want.split(" ")))
    left = sum(a != b for made, want in lines for a, b in zip(model.repair(made)[1].split(" "), want.split(" ")))
    assert pieces > 200 and left <= 0.03 * pieces
