"""Rows that operators must survive: nulls, empty and very long texts, repeats, clashing names."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, size int, id string, node int, code string"
CLASH = ("r", 1, "i", 2, "c")


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = state * 1103515245 + 12345 & 0x7FFFFFFF
        out.append("w" + format(state >> 8 & 0x3FFF, "x"))
    return " ".join(out)


def odd_rows():
    long = prose(99, 40_000)
    texts = {
        0: prose(1, 120), 1: prose(1, 120), 2: prose(1, 118) + " other end", 3: None, 4: "", 5: " \t\n ",
        6: "one", 7: "ONE", 8: long, 9: long + " tail", 10: "été 中文。 " + prose(2, 60),
        11: "1234 !!! 5678", 12: prose(3, 90), 13: "x" * 5000, 14: prose(4, 70) + " " + prose(1, 40),
        15: "a b c a b c a b c " * 30, 16: "<|endoftext|> it's I'll. don't!? " + prose(5, 55),
    }
    sources = ["src1", "src2", None, "ä", "src1"]
    rows = [(k, t, "en" if k % 3 else "fr", sources[k % 5], len(t or ""), *CLASH) for k, t in texts.items()]
    rows += [rows[12], rows[12], (None, prose(6, 80), None, None, None, *CLASH), (None, None, None, None, None, *CLASH)]
    return rows
