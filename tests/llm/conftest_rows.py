"""Rows that operators must not stumble over."""

KINDS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, kept string, start string, key string, stratum string, taken string, component string, version string, `drop` string"


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, "x", "y", "z", "s", "t", "c", "v", "d")


LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000)) + "\n" + "a shared line that is long enough\n" * 3
BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of rare blue herbs near the old stone bridge at dusk and sing"
ROWS = [
    _row(1, BASE + " one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    _row(2, BASE.upper() + " one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    _row(3, BASE + " one two three four five six seven eight nine ten eleven twelve thirteen changed"),
    _row(4, None, None, None),
    _row(5, "", "", None),
    _row(6, "short one"),
    _row(7, "short\tone", "de", "b"),
    _row(8, LONG, "fr", "é"),
    _row(9, "a shared line that is long enough\n\nA Shared line that is long enough  \nown line of the ninth document\nown line of the ninth document"),
    _row(9, "a shared line that is long enough\n\nA Shared line that is long enough  \nown line of the ninth document\nown line of the ninth document"),
    _row(10, " \t \n \x0b", "en", "b"),
    _row(None, "a shared line that is long enough", "en", "b"),
    _row(11, "tab\tand\x1cother   spaces here <|endoftext|> done  twice\n line"),
    _row(12, "#!$%& " * 70 + "\n" + "same words again " * 40),
]


def texts():
    return [(r[0], r[1]) for r in ROWS]
