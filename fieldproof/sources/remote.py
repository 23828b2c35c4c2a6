"""An analyzer that asks a model behind an HTTP interface of one of two shapes. Only the standard library is used."""

from __future__ import annotations

import base64
import json
import mimetypes
import time
import urllib.error
import urllib.request
from pathlib import Path
from typing import Any

from ..operators.infer import prompt
from .readers import Settings, settings

#: Seconds that a request may take, how often it is tried again, and what stands for a missing key.
TIMEOUT, RETRIES, NO_KEY = 120.0, 2, "replace_me"
#: Answers after which a request is tried again.
AGAIN = (408, 409, 429, 500, 502, 503, 504)
#: Our own wording of what every document is asked under.
SYSTEM = (
    "You read values from the image of one document. Report only what is printed there and legible; never complete or compute. "
    'Reply with a single JSON object and nothing else: {"document_type": text or null, "fields": {each requested name: its value or null}, "answer": text, '
    '"evidence": [{"field": name, "text": what is printed}], "uncertainties": [text], "confidence": number from 0 to 1}.'
)
COMPACT = 'Read the requested amounts from the receipt. Reply with one JSON object only: {"fields": {each requested name: the printed text or null}}.'


class Remote:
    """One per task. ``analyze`` returns the model's text, which is parsed with all others, and what is known of the call."""

    def __init__(self, chosen: Settings | None = None):
        self.settings = s = chosen or settings()
        if not (s.api_key or "").strip() or s.api_key.strip() == NO_KEY:
            raise RuntimeError("MLLM_API_KEY is missing")

    def describe(self) -> dict[str, Any]:
        s = self.settings
        return {"backend": s.backend, "model": s.model, "api_mode": s.api_mode, "system_prompt": self._system(), "receipt_profile": s.profile}

    def _system(self) -> str:
        return COMPACT if self.settings.profile == "receipt-compact-v1" else SYSTEM

    def request(self, image: str, question: str, field_schema: dict[str, Any], profile: str) -> tuple[str, dict[str, Any]]:
        """(path, body) of a request."""
        kind = mimetypes.guess_type(image)[0] or "image/png"
        url = f"data:{kind};base64,{base64.b64encode(Path(image).read_bytes()).decode('ascii')}"
        text = prompt(question, field_schema, profile)
        if self.settings.api_mode == "responses":
            content = [{"type": "input_text", "text": text}, {"type": "input_image", "image_url": url}]
            return "responses", {"model": self.settings.model, "instructions": self._system(), "input": [{"role": "user", "content": content}]}
        content = [{"type": "text", "text": text}, {"type": "image_url", "image_url": {"url": url}}]
        return "chat/completions", {"model": self.settings.model, "messages": [{"role": "system", "content": self._system()}, {"role": "user", "content": content}]}

    def _sent(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        target = f"{self.settings.base_url.rstrip('/')}/{path}"
        head = {"Authorization": f"Bearer {self.settings.api_key.strip()}", "Content-Type": "application/json"}
        for left in range(RETRIES, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(target, json.dumps(body).encode(), head), timeout=TIMEOUT) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if not left or e.code not in AGAIN:
                    raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode('utf-8', 'replace')}") from e
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(0.5 * 2 ** (RETRIES - left))
        raise AssertionError

    def analyze(self, image: str, question: str, field_schema: dict[str, Any], *, receipt_profile: str | None = None) -> tuple[str, dict[str, Any]]:
        began, s = time.perf_counter(), self.settings
        profile = s.profile if receipt_profile is None else receipt_profile
        reply = self._sent(*self.request(image, question, field_schema, profile))
        if s.api_mode == "responses":
            said = [part.get("text") or "" for item in reply.get("output") or () for part in item.get("content") or () if part.get("type") == "output_text"]
            text = "".join(said)
        else:
            text = reply["choices"][0]["message"].get("content") or ""
        return text, {"backend": s.backend, "model": s.model, "api_mode": s.api_mode, "receipt_profile": profile, "latency_seconds": round(time.perf_counter() - began, 3)}
