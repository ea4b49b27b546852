"""Letters, marks and digits of Unicode 13, which all supported JVMs know, as alphabets of similar characters.

The list is fixed, so that alphabets, and with them pseudonyms, are the same with any version of Python.
"""

from __future__ import annotations

import unicodedata

#: Runs of characters: distance from the end of the run before, and length less one, both hexadecimal.
_RUNS = """
30-9 8-19 7-19 30 8-1 2 4-1 2-2 2-16 2-1e 2-1c9 5-b f-4 8 2 12-74 2-1 3-3 2 7 2-2 2 2-13 2-52 2-8a 2-ac 2-25 3 7-28 9-2c 2 2-1 2-1
2 9-1a 5-3 1e-a 6-49 5-65 2-7 3-9 2-12 3 11-3a 3-64 f-35 5 3 3-2d 13-1b 5-a 36-14 2-11 c-e 2-80 3-9 2-12 2-7 3-1 3-15 2-6 2 4-3
3-8 3-1 3-3 9 5-1 2-4 3-b 3-5 3 2 3-2 2-5 5-1 3-15 2-6 2-1 2-1 2-1 3 2-4 5-1 3-2 4 8-3 2 8-f c-2 2-8 2-2 2-15 2-6 2-1 2-4 3-9 2-2
2-2 3 10-3 3-9 a-6 2-2 2-7 3-1 3-15 2-6 2-1 2-4 3-8 3-1 3-2 8-2 5-1 2-4 3-9 2-6 b-1 2-5 4-2 2-3 4-1 2 2-1 4-1 4-2 4-b 5-4 4-2 2-3
3 7 f-c e-c 2-2 2-16 2-f 4-7 2-2 2-3 8-1 2-2 6-3 3-9 9-6 2-3 2-7 2-2 2-16 2-9 2-4 3-8 2-2 2-3 8-1 8 2-3 3-9 2-1 e-c 2-2 2-32 2-2
2-4 6-f 3-12 2-5 2-2 2-11 4-17 2-8 2 3-6 4 5-5 2 2-7 7-9 3-1 e-39 6-e 2-9 28-1 2 2-4 2-17 2 2-16 3-4 2 2-5 3-9 3-3 21 18-1 7-13 2
2 2 5-9 2-23 5-13 2-11 2-23 a 3a-49 7-4d 3-25 2 6 3-2a 2-14c 2-3 3-6 2 2-3 3-28 2-3 3-20 2-3 3-6 2 2-3 3-e 2-38 2-3 3-42 3-2 a-13
4-f 11-55 3-5 4-26b 3-10 2-19 6-4a 4-a 8-c 2-6 c-14 c-13 d-c 2-2 2-1 d-53 4 5-1 3-9 7-9 12-2 3-9 7-58 8-2a 6-45 b-1e 2-b 5-b b-27
3-4 c-2b 5-19 7-a 26-1b 5-3e 2-1c 3-a 7-9 e 9-10 40-4b 5-9 12-8 d-73 d-37 9-9 4-30 3-8 8-2a 3-2 11-2 2-26 6-f9 2-11a 3-5 3-25 3-5
3-7 2 2 2 2-1e 3-34 2-6 2 4-2 2-6 4-3 3-5 5-c 6-2 2-6 74-1 3-5 6-a 7-c 34-20 12 5 3-9 2 4-4 7 2 2 2-3 2-a 3-3 6-4 5 2-39 2d7-3b
4f-15 277-1d 46d-2e 2-2e 2-84 7-8 a 3-25 2 6 3-37 8 10-17 a-6 2-6 2-6 2-6 2-6 2-6 2-6 2-6 2-1f 30 1d6-2 1a-e 2-4 3-4 5-55 3-1 3-2
2-59 2-3 6-2a 2-5d 4-3 b-1f 31-f 21-9 1f-7 2-e 21-9 28-e 141-19bf 41-51fc 4-48c 44-2d 3-10c 4-1b 15-32 2-9 2-72 26-8 3-66 3-34 3-8
2b-32 5 4-5 b-33 d-45 b-9 7-17 4 2-30 3-23 d-1c 4-40 f-a 7-1e 2-36 a-d 3-9 7-16 4-48 19-2 3-f 3-4 b-5 3-5 3-5 a-6 2-6 2-2a 2-d
7-7a 2-1 3-9 7-2ba3 d-16 5-30 2105-16d 3-69 27-6 d-4 6-b 2-c 2-4 2 2-1 2-1 2-6b 22-16a 13-3f 3-35 29-b 5-f 11-f 41-4 2-86 14-9
8-19 7-19 c-58 4-5 3-5 3-5 3-2 24-b 2-19 2-12 2-1 2-e 3-d 23-7a d-2c d-38 12-1 72 83-1c 4-30 10-1b 5-23 a-1d 6-2a 6-1d 3-23 5-7
2-4 2b-9d 3-9 7-23 5-23 5-27 9-33 9d-136 a-15 b-7 99-5 3 2-2b 2-1 4 3-16 3-1e 3-25 9-8 31-12 2-1 6-20 5-19 47-37 5-13 3-31 2-1 6-7
2-2 2-1c 3-2 5-9 18-1e 2-1f 21-7 2-1d 5-4 11-35 b-15 3-1a 6-19 18-6 51-48 38-32 e-32 8-2d 9-9 127-1e 2-29 2-1 4-1 4f-27 9-24 5c-1b
15-16 a-46 c-1d 10-3b 16-18 8-9 7-34 2-9 5-3 9-23 3 a-44 5-3 2-c 2 5-13 c-11 2-24 7 42-6 2 2-3 2-e 2-9 8-3a 6-9 7-3 2-7 3-1 3-15
2-6 2-1 2-4 2-9 3-1 3-2 3 7 6-6 3-6 4-4 8c-4a 6-9 5-3 1f-45 2 9-9 a7-35 3-8 18-5 23-40 4 c-9 27-38 8-9 37-1a 3-e 5-b c5-3a 66-52
d-7 3 3-7 2-1 2-1d 2-1 3-8 d-9 47-7 3-2d 3-7 2-1 1c-3e 9 9-49 4 23-38 108-8 2-2c 2-8 10-1c 6-1d 3-15 2-d 4a-6 2-1 2-2b 4 2-1 2-8
9-9 7-5 2-1 2-24 2-1 2-5 8-9 137-16 ba 10-14 2c-399 67-6e 12-c3 abd-42e fd2-246 21ba-238 8-1e 2-9 67-1d 3-4 c-36 a-3 d-9 2-6 2-14
6-12 2b1-56 6a-4a 5-38 8-10 41-1 2-1 c-1 f-17f7 9-4d5 2b-8 22f8-11e 32-2 12-3 9-18b 905-6a 6-c 4-8 8-9 4-1 14c7-4 4-5 9-7 3-6 1f-3
95-2 9c-13 6d-18 88-54 2-46 2-1 3 3-1 3-3 2-b 2 2-6 2-40 2-3 3-7 2-6 2-1b 2-3 2-4 2 4-6 2-153 3-18 2-18 2-1e 2-18 2-1e 2-18 2-1e
2-18 2-1e 2-18 2-7 3-31 201-36 5-31 9 f 17-4 2-e 551-6 2-10 3-6 2-1 2-4 d6-2c 4-d 3-9 5 172-39 507-c4 3-f 2a-4b 5-9 318-3a 2-2 2-3
4d-2c 2-e c3-3 2-1a 2-1 2 3 2-9 2-3 2 2 7 5 2 2 2-2 2-1 2 3 2 2 2 2 2-1 2 3-3 2-6 2-3 2-3 2 2-9 2-10 6-2 2-4 2-10 245-c ae4-9
407-a6dd 23-1034 c-dd 3-1681 f-1d30 c20-21d 5e3-134a aedb6-ef
"""
LONG = 300  # runs of at least this many characters are alphabets of their own
FEW = 10  # smaller alphabets are joined with others of the same kind


def _characters() -> list[range]:
    out, at = [], 0
    for run in _RUNS.split():
        skip, _, more = run.partition("-")
        first = at + int(skip, 16)
        at = first + int(more or "0", 16)
        out.append(range(first, at + 1))
    return out


def alphabets(taken: str) -> tuple[list[tuple[int, int]], list[str]]:
    """(first, last) of the long runs, and the other characters by script and category, without those of `taken`."""
    runs, groups = [], {}
    for run in _characters():
        if len(run) >= LONG and not any(chr(i) in taken for i in run) and len({unicodedata.category(chr(i)) for i in run}) == 1:
            runs.append((run[0], run[-1]))
            continue
        for c in map(chr, run):
            if c not in taken:
                groups.setdefault((unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]), []).append(c)
    joined = {}
    for (category, script), found in sorted(groups.items()):
        joined.setdefault((category, script) if len(found) >= FEW else (category[0], ""), []).extend(found)
    return runs, ["".join(found) for _, found in sorted(joined.items())]
