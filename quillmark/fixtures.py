"""A small laid-out document, the same in Spark and in SQL, for the layout queries.

The driver's tables have no page boxes, so layout queries run on these rows in full.
"""

from __future__ import annotations

#: doc_id, page, block_no, page_height, x0, y0, x1, y1, size, bold, text
BLOCKS = [
    (1, 0, 0, 792.0, 54.0, 20.0, 300.0, 30.0, 8.0, 0, "Journal of Tests 2021"),
    (1, 0, 1, 792.0, 54.0, 80.0, 558.0, 100.0, 16.0, 48, "Counting Migratory Birds from Tower Radar Images"),
    (1, 0, 2, 792.0, 54.0, 120.0, 200.0, 132.0, 11.0, 8, "Abstract"),
    (1, 0, 3, 792.0, 54.0, 140.0, 297.0, 200.0, 9.0, 0, "We count birds at night. It works in all kinds of weather"),
    (1, 0, 4, 792.0, 54.0, 220.0, 200.0, 232.0, 11.0, 15, "1. Introduction"),
    (1, 0, 5, 792.0, 54.0, 240.0, 297.0, 300.0, 9.0, 0, "Nights are dark. Radar sees through and"),
    (1, 0, 6, 792.0, 315.0, 80.0, 558.0, 140.0, 9.0, 0, "towers see more of it."),
    (1, 0, 7, 792.0, 320.0, 310.0, 540.0, 322.0, 8.0, 0, "Fig. 1: Flocks by hour."),
    (1, 0, 8, 792.0, 330.0, 200.0, 360.0, 210.0, 7.0, 0, "time us"),
    (1, 0, 9, 792.0, 300.0, 770.0, 312.0, 780.0, 8.0, 0, "1"),
    (1, 1, 0, 792.0, 54.0, 20.0, 300.0, 30.0, 8.0, 0, "Journal of Tests 2022"),
    (1, 1, 1, 792.0, 54.0, 80.0, 297.0, 140.0, 9.0, 0, "The results follow."),
    (1, 1, 2, 792.0, 54.0, 160.0, 200.0, 172.0, 11.0, 10, "References"),
    (1, 1, 3, 792.0, 54.0, 180.0, 297.0, 200.0, 9.0, 0, "[1] A. Writer. A paper about flocks."),
    (1, 1, 4, 792.0, 300.0, 770.0, 312.0, 780.0, 8.0, 0, "Page 2 of 2"),
    (2, 0, 0, 792.0, 54.0, 80.0, 297.0, 140.0, 10.0, 0, "Only one block here."),
]
#: doc_id, id, page, x0, y0, x1, y1, kind
FIGURES = [
    (1, 0, 0, 320.0, 180.0, 540.0, 300.0, "vector"),
    (1, 1, 0, 60.0, 500.0, 200.0, 600.0, "raster"),
    (1, 2, 0, 58.0, 498.0, 202.0, 602.0, "vector"),
    (1, 3, 1, 60.0, 300.0, 200.0, 330.0, "raster"),
]
#: doc_id, n_pages
PAGES = [(1, 2), (2, 1)]
#: doc_id, page, line_no, value
OCR = [
    (7, 0, 0, "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"),
    (7, 0, 1, "5\t1\t1\t1\t1\t1\t300\t300\t150\t50\t96\tScanned"),
    (7, 0, 2, "5\t1\t1\t1\t1\t2\t480\t300\t120\t48\t96\ttext"),
    (7, 0, 3, "5\t1\t1\t1\t2\t1\t300\t375\t90\t50\t91\there"),
    (7, 0, 4, "5\t1\t2\t1\t1\t1\t300\t600\t90\t50\t91\tnext"),
    (7, 0, 5, "5\t1\t2\t1\t1\t2\t400\t600\t90\t50\t91\t "),
    (7, 0, 6, "4\t1\t2\t1\t1\t2\t400\t600\t90\t50\t91\tline"),
]
#: hash words of two collections of figures: doc_id, id, sha, phash, dhash, crop
HASHES = [
    (1, 0, "aa", 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0.10),
    (1, 1, "bb", 0x123456789ABCDEF0, 0x0FEDCBA987654321, 0.90),
    (2, 0, "aa", 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0.10),
    (2, 1, "cc", 0x0F0F0F0F0F0F0F0E, 0x00FF00FF00FF00FE, 0.20),
    (2, 2, "dd", 0x123456789ABC0F0F, 0x7FEDCBA987654321, 0.86),
    (2, 3, "ee", 0x0F0F0F0F0F0F1234, 0x7777777777777777, 0.30),
]


def values(rows: list[tuple]) -> str:
    """SQL literals of rows."""
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "(values " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + ")"
