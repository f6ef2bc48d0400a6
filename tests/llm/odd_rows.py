"""Tables with every odd case: NULLs, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHES = "key row kept score rank n ids gram doc at sub h root place tie words held_out".split()

PASSAGE = "one passage that stands in many places of this small corpus and is far longer than a hundred bytes in all "


def odd_texts() -> list[tuple]:
    plain = "the cat of the house and the dog in a garden is as good as any that was to be for on it with by this or from "
    return [
        (1, plain * 3 + PASSAGE + "end one", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "en"),
        (5, plain * 3 + PASSAGE + "end one", "en"),
        (5, plain * 3 + PASSAGE + "end one", "en"),
        (6, "x", "en"),
        (7, PASSAGE + "el perro de la casa y el gato en una calle que es de los otros " * 4, "es"),
        (None, "le chat de la maison et le chien dans un jardin " * 5, "fr"),
        (None, None, None),
        (8, "ß€𝄞 " + PASSAGE.replace("corpus", "cörpüs") + "\n\nDie Katze und der Hund in dem Haus " * 6, "de"),
        (9, "long " * 60_000, "en"),
        (10, "y" * 30_000 + "  z   \n zz  ", None),
        (11, "1234567890 $$$ ### ... !!!", "en"),
    ]


def with_clashes(df):
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])
