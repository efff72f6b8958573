"""Small histories for the tests."""

from datetime import datetime, timedelta

TURNS = "history_id string, id string, session_id string, session_ts timestamp_ntz, speaker string, text string, ts timestamp_ntz, seq int"
QUESTIONS = "qid string, history_id string, qtype string, question string, answer string, now timestamp_ntz"


def turns(spark, sessions, history="h"):
    """Turns of (session id, start, [(speaker, text)]); a text may come with hours after the start."""
    out = []
    for sid, start, said in sessions:
        at = datetime.fromisoformat(start)
        for k, (speaker, text, *later) in enumerate(said):
            out.append((history, f"{sid}:{k}", sid, at, speaker, text, at + timedelta(hours=later[0] if later else 0), k))
    return spark.createDataFrame(out, TURNS)


def questions(spark, rows, history="h"):
    return spark.createDataFrame([(q, history, kind, text, answer, datetime.fromisoformat(now)) for q, kind, text, answer, now in rows], QUESTIONS)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


HISTORY = [
    ("s1", "2024-01-10 09:00", [("user", "I adopted a puppy named Biscuit"), ("assistant", "Congratulations, what breed is Biscuit?"), ("user", "A corgi"), ("assistant", "ok")]),
    ("s2", "2024-03-05 18:00", [("user", "We moved to Lisbon last month"), ("assistant", "How is Lisbon?"), ("user", "ok thanks")]),
    ("s3", "2024-06-20 12:00", [("user", "Biscuit learned a new trick in Porto"), ("assistant", "Which trick?"), ("user", "Rolling over")]),
]
