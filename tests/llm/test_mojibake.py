import random

from tramline.llm.mojibake import CHAINS, garbled_rows, originals, restored_lossy

SCHEMA = "tab string, src string, row_id bigint, text string, mix string, word string, n int"


def garble(text, chain):
    for read, written in reversed(CHAINS[chain]):
        raw = text.encode(written)
        text = "".join(chr(b) if read == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read) for b in raw) if read != "utf8" else raw.decode(read)
    return text


def names(rng, n):
    a, b = ["Klè", "Brû", "Té", "Mâ", "Pô", "Drî", "Sê", "Zü", "Fë", "Gla"], ["mont", "ville", "rive", "lieu", "court", "zac"]
    kinds = ["Hôpital {}", "Forêt-de-{}", "Musée {}", "Quai {} B", "Collège {}", "Arrêt {} à {}", "Øre {}", "SÃO {}", "{} § 3 ½", "Marché «{}»"]
    word = lambda: rng.choice(a) + rng.choice(["ra", "ni", "lo", ""]) + rng.choice(b)
    return [rng.choice(kinds).format(word(), word()) for _ in range(n)]


def test_chains_undo_themselves():
    for chain in CHAINS:
        got = garble("Forêt", chain)
        assert got == "Forêt" or "Forêt" in originals(got), chain


def test_found_and_restored(spark):
    rng = random.Random(6)
    rows, bad = [], {}
    for i, t in enumerate(names(rng, 5000)):
        src = rng.choice("ab")
        chain = rng.choice(["utf8 as cp1252", "utf8 as macroman", "utf8 as cp1252 twice", "macroman as cp1252", "cp850 as cp1252", "lossy"])
        if rng.random() < 0.08:
            try:
                g = t.encode("cp1252").decode("utf8", errors="replace") if chain == "lossy" else garble(t, chain)
            except (UnicodeEncodeError, UnicodeDecodeError):
                g = t
            if g != t:
                bad[i] = t
            t = g
        rows.append(("stops", src, i, t, "", "", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_id: r.repaired for r in garbled_rows(df).collect()}
    assert len(set(got) & set(bad)) >= 0.97 * len(bad) and len(set(got) - set(bad)) <= 0.03 * len(bad)
    assert sum(got.get(i) == t for i, t in bad.items()) >= 0.6 * len(bad)
    mended = {r.row_id: r.repaired for r in restored_lossy(df.select("tab", "row_id", "text"), garbled_rows(df)).collect()}
    assert sum(mended.get(i) == t for i, t in bad.items()) >= sum(got.get(i) == t for i, t in bad.items())


def test_nulls_empties_ascii_and_long_texts(spark):
    rows = [("t", None, 1, None, "", "", 0), ("t", None, 2, "", "", "", 0), ("t", "", 3, "plain", "", "", 0), ("t", "", 4, "é" * 50_000, "", "", 0), (None, None, 5, "été", "", "", 0), ("t", "s", 6, "op�re", "", "", 0), ("t", "s", 6, "op�re", "", "", 0)]
    assert sorted(r.row_id for r in garbled_rows(spark.createDataFrame(rows, SCHEMA)).collect()) == [6, 6]
    assert garbled_rows(spark.createDataFrame([], SCHEMA)).collect() == []
