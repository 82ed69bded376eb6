"""Texts for the tests."""


def words(n, start=0, stem="w"):
    return " ".join(f"{stem}{start + i}" for i in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, words(30)), (5, words(30)), (6, words(30)), (6, words(30)), (7, "é " + words(20, 500)), (8, words(4000, 10_000))]
