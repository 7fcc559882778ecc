"""Texts that operators must bear."""

#: Texts that operators must bear: null, empty, blank, odd characters, very long, shared passages, near copies.
WORDS = "the of and to in is that for it was on are as with they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def sentence(seed, n):
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * 17 * seed) % len(WORDS)] for i in range(n))


PASSAGE = sentence(5, 40)
TEXTS = [
    (1, sentence(1, 60)),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, f"{sentence(2, 20)} {PASSAGE} {sentence(3, 20)}"),
    (6, f"{sentence(4, 20)} {PASSAGE}"),
    (7, sentence(1, 60)),
    (8, sentence(1, 60).replace("the", "THE")),
    (9, "é😀 ①ﬁ \x00 ﻿ ▁▁ a  b   " + "ü" * 70),
    (10, "long " * 30_000),
    (11, "x"),
    (12, f"{sentence(6, 300)}"),
    (12, f"{sentence(6, 300)}"),
    (None, sentence(1, 60)),
    (None, None),
    (13, "1234 5678 !!"),
]
