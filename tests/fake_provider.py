"""A provider for tests: it counts its calls in files, fails as prompts ask, and can take its process with it."""

import os
import uuid
from pathlib import Path

from gristmill.sources.model_source import Refused


def answer(model, prompt):
    calls = Path(model)
    (calls / uuid.uuid4().hex).write_text(prompt)
    n = sum(x.read_text() == prompt for x in calls.iterdir())
    if prompt.startswith("refuse"):
        raise Refused("no")
    if prompt.startswith("twice") and n < 3:
        raise OSError("busy")
    if prompt.startswith("never"):
        raise OSError("down")
    if prompt.startswith("die") and n == 1:
        os._exit(1)
    return f"answer to {prompt}"
