import re

from tilespan.llm import quotes


def norm(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def plain(rows):
    """The linked rows by loops."""
    parsed = []
    for conv, turn, _, text in rows:
        lines = []
        for line in re.sub("\r\n?", "\n", text or "").split("\n"):
            m = re.match(r"^[ \t]{0,3}((?:>[ \t]?)+)", line)
            lines.append((m[1].count(">") if m else 0, line[m.end() :] if m else line))
        kept = [x for k, x in enumerate(lines) if not (x[0] == 0 and re.match(r"(?i)^[ \t]*on\b.{1,200}\bwrote:[ \t]*$", x[1]) and k + 1 < len(lines) and lines[k + 1][0] > 0)]
        own = "\n".join(c for n, c in kept if n == 0)
        if any(n for n, _ in kept):
            own = re.sub("\n{3,}", "\n\n", own).strip(" ")
        runs, last = [], None
        for n, c in kept:
            if n and n == last:
                runs[-1][1].append(c)
            elif n:
                runs.append((n, [c]))
            last = n
        parsed.append((conv, turn, own, max(n for n, _ in kept), runs))
    index = {}
    for conv, turn, own, *_ in parsed:
        if conv is None or turn is None:
            continue
        for part in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
            if norm(part):
                key = conv, norm(part)
                index[key] = min(index.get(key, turn), turn)
    reply, out = {}, []
    for conv, turn, own, level, runs in parsed:
        for n, lines in runs:
            keys = [(2, norm(" ".join(lines))), *((1, norm(x)) for x in lines)]
            for rank, key in keys:
                origin = index.get((conv, key))
                if key and n == 1 and turn is not None and origin is not None and origin < turn:
                    reply[conv, turn] = max(reply.get((conv, turn), (0, 0, 0)), (rank, len(key), origin))
    for conv, turn, own, level, _ in parsed:
        at, depth = turn, 0
        while (conv, at) in reply:
            at, depth = reply[conv, at][2], depth + 1
        out.append((conv, turn, own, level, reply.get((conv, turn), (0, 0, None))[2], at, depth))
    return sorted(map(repr, out))


ROWS = [
    (1, 0, "user", "Hello there, World!\nSecond line.\n\nA new paragraph\nof two lines."),
    (1, 1, "assistant", "On Monday, Bob wrote:\n> hello there world\n> Second line.\nMy answer."),
    (1, 2, "user", ">> Hello there, WORLD!\n>> second LINE\n> My answer.\nThanks."),
    (1, 3, "user", "> a new paragraph of two lines\n\n\n\nNoted.\r\n> > unknown words\nEnd"),
    (1, 4, "user", ">Thanks.\nOK"),
    (1, 5, "user", "> OK\n> Noted.\nyes"),
    (1, 6, "user", "> nowhere to be found\nyes"),
    (1, 6, "user", "> OK\nagain, the same turn"),
    (2, 0, "user", "> Thanks.\nother conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", "> \n>\n> !!!\nnothing quoted"),
    (2, 4, "user", "> other conversation"),
    (2, 4, "user", "> other conversation"),
    (None, 1, "user", "> Thanks."),
    (3, None, "user", "> Thanks."),
    (4, 0, None, "x > y is no quote\n    > nor is this"),
    (5, 0, "user", "long " * 20000),
    (5, 1, "user", "> " + "long " * 20000 + "\nanswer"),
    (6, 5, "user", "> later words\nfirst"),
    (6, 7, "user", "later words"),
]


def test_linked(spark):
    table = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, reply_depth long")
    found = quotes.linked(table)
    got = [(r.conv_id, r.turn, r.own_text, r.max_level, r.reply_to, r.thread_turn, r.reply_depth) for r in found.collect()]
    want = plain(ROWS)
    # Rows that repeat a turn reply as one message.
    assert sorted(map(repr, got)) == want
    assert set(quotes.ADDED) <= set(found.columns)
    assert quotes.linked(table.limit(0)).count() == 0
    chain = [(9, 0, "user", "start 0")] + [(9, t, "user", f"> start {t - 1}\nstart {t}") for t in range(1, 20)]
    table = spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")
    assert {(r.turn, r.thread_turn, r.reply_depth) for r in quotes.linked(table).collect()} == {(t, 0, t) for t in range(20)}


def test_native(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = quotes.linked(table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
