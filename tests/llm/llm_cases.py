"""Rows that hold the odd cases."""

ODD = [
    (5, "Hello world, it's  a\n\n test 12345 !!"),
    (3, None),
    (1, ""),
    (None, "null id ü é <|endoftext|> tail"),
    (2, "中文 mixed ἀρχή ΑΣ İstanbul Ɓ   x"),
    (7, "a" * 9000 + " " + "word " * 6000),
    (8, "same text"),
    (8, "same text"),
    (8, "other text"),
    (9, "   "),
    (10, "nul \x00 nul a\x00b a\x00c a nul \x00 nul a\x00b a\x00c a"),
]
