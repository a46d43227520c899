"""Cut texts judged on texts written and labelled by hand; the model is fitted on the memories of a small folder."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm.truncation import cut_scores

CUT = """
The landlord said that the heating would be repaired before the end of
We compared three vendors and the second one was cheaper, but the contr
Remember to bring the passport, the tickets and
Die Lieferung kommt erst nächste Woche, weil der Fahrer
Le rapport montre que les ventes ont baissé depuis janvier et que la direc
The plan has two parts. First we clean the data. Second, we move it to the new
El cliente pidió que le enviáramos la factura por correo, aunque ya la había rec
{"name": "kitchen", "lamps": [{"id": 1, "on": true}, {"id": 2, "o
{"status": "ok", "items": ["bread", "milk", "but
Run this first:\\n```\\nfor f in *.csv; do\\n  head -1 "$f"
Steps to reproduce the crash: open the settings, choose the second tab, then clic
I told him that the meeting (which was moved to Friday because of the holi
The server answered with a long list of warnings, most of them about the old cer...
She wrote that the trip was fine, the hotel was small and the food was [truncated]
Nobody expected that the bridge would be closed for so long, and the detour thro…
Przesyłka dotarła wczoraj wieczorem, ale pudełko było uszkodzone i brakow
После обновления программа перестала открываться, и мы решили верн
""".strip().split("\n")
WHOLE = """
The landlord said that the heating would be repaired before the end of the week.
We compared three vendors and the second one was cheaper.
Remember to bring the passport, the tickets and the keys!
Die Lieferung kommt erst nächste Woche, weil der Fahrer krank ist.
Le rapport montre que les ventes ont baissé depuis janvier.
Did anybody water the plants while we were away?
El cliente pidió que le enviáramos la factura por correo.
{"name": "kitchen", "lamps": [{"id": 1, "on": true}, {"id": 2, "on": false}]}
{"status": "ok", "items": ["bread", "milk", "butter"]}
Run this first:\\n```\\nfor f in *.csv; do\\n  head -1 "$f"\\ndone\\n```
git log --oneline -5
ok, thanks
sounds good
npm run build
The meeting was moved to Friday (because of the holiday).
She asked: "Is this the way to the station?"
Przesyłka dotarła wczoraj wieczorem, ale pudełko było uszkodzone.
После обновления программа перестала открываться.
""".strip().split("\n")


@pytest.mark.parametrize("source", ["cli"])
def test_texts_labelled_by_hand(spark, source):
    memories = spark.read.parquet("/root/testdata/sf0.01/memories.parquet").select("id", "content", F.lower(F.trim("source")).alias("source"))
    mine = spark.createDataFrame([(f"{k}{i}", t.replace("\\n", "\n"), source) for k, texts in (("cut", CUT), ("whole", WHOLE)) for i, t in enumerate(texts)], "id string, content string, source string")
    got = {r.id: r.probability >= 0.5 for r in cut_scores(memories.unionByName(mine), "id", "content", "source").collect()}
    missed = [t for i, t in enumerate(CUT) if not got[f"cut{i}"]]
    wrong = [t for i, t in enumerate(WHOLE) if got[f"whole{i}"]]
    assert len(missed) <= 2 and len(wrong) <= 2, (missed, wrong)
