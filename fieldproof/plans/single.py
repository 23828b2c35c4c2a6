"""One document, read at once: for a page or a shell. The same plan as a run's, over a table of one row."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.infer import Analyzer, infer
from ..session import durable, new_path, ship
from .recheck import answers, reread

NO_IMAGE = "No image was given."
DONE = "Done."


def read(spark: SparkSession, make: Callable[[], Analyzer], image: str | None, question: str, schema_text: str, policy: str = "none") -> tuple[str, dict[str, Any] | None]:
    """(status, prediction). Whatever fails becomes the status, and the prediction is null then."""
    if not image:
        return NO_IMAGE, None
    try:
        names = list(json.loads(schema_text))
        asked = ship(spark).createDataFrame([("one", image, question, schema_text)], "id string, image string, question string, field_schema string")
        first = durable(answers(infer(asked, make, new_path(spark, "ledger")), asked).select("id", "prediction", "error"), "answers")
        error = first.first()["error"]
        if error:
            return f"Failed: {error}", None
        documents = asked.select("id", "image", "question", F.parse_json("field_schema").alias("field_schema"), F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("requested"))
        reviewed = reread(documents.join(first.select("id", F.parse_json("prediction").alias("prediction")), "id"), make, policy)
        return DONE, json.loads(reviewed.first()["prediction"])
    except Exception as e:  # noqa: BLE001  the caller shows what went wrong
        return f"Failed: {type(e).__name__}: {e}".splitlines()[0], None
