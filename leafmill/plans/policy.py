"""Decisions taken before a plan is made: accuracy, strategies, variants, prompts. Plain Python."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from leafmill.schemas import LIMITS


@dataclass(frozen=True)
class Accuracy:
    mode: str
    quality: int
    votes: int
    high_resolution: bool
    verify: bool
    concurrency: int


def accuracy(mode: str | None = None, quality: int | None = None, votes: int | None = None, high_resolution: bool | None = None, verify: bool | None = None, max_api_concurrency: float | None = None, concurrency: float | None = None, most: int = LIMITS["concurrency_most"]) -> Accuracy:
    """``fast``, ``balanced`` (also for what isn't known) or ``max``."""
    mode = (mode or "").lower() if (mode or "").lower() in ("fast", "balanced", "max") else "balanced"
    calls = max_api_concurrency if max_api_concurrency is not None else concurrency if concurrency is not None else LIMITS["concurrency"]
    n = min(max(1, math.floor(calls)), most)
    if mode == "fast":
        return Accuracy(mode, min(quality or 90, 85), 1, high_resolution is True, verify is True, n)
    if mode == "max":
        return Accuracy(mode, max(quality or 95, 95), max(votes or LIMITS["votes"], 3), high_resolution is not False, verify is not False, n)
    return Accuracy(mode, quality or 95, votes or LIMITS["votes"], high_resolution is not False, verify is not False, n)


def reading_strategy(document_type: str, forced: str | None = None, env: dict | None = None) -> str:
    """Forced, else the environment's, else by type: only tables take the layered path."""
    chosen = forced or (env if env is not None else os.environ).get("EXTRACT_STRATEGY")
    if chosen in ("full_page", "layered"):
        return chosen
    return "layered" if document_type == "table" else "full_page"


def preprocess_variants(asked: list[str] | str | None) -> list[str]:
    """Variants as a set in order; ``forensic`` stands for five."""
    asked = [asked] if isinstance(asked, str) else list(asked or ["original"])
    five = ["original", "light", "aggressive", "negative", "scanned"]
    out = [v for a in asked for v in (five if a == "forensic" else [a])]
    return list(dict.fromkeys(out))


def export_formats(asked: list[str] | None) -> list[str]:
    return list(dict.fromkeys(a.strip().lower() for a in asked)) if asked else ["json", "ndjson", "xlsx", "markdown"]


def summarize_errors(result: dict) -> list[str]:
    e = result.get("errors") or ([result["error"]] if result.get("error") else [])
    return [x if isinstance(x, str) else str(x.get("message") or x.get("error") or x) for x in (e if isinstance(e, list) else [e])]


def model_parameters(model: str, temperature: float = 0.1, thinking: bool | None = None, max_tokens: int | None = None, pixels: tuple[int, int] | None = None) -> dict:
    out = {"model": model, "temperature": temperature, "max_tokens": min(max_tokens or LIMITS["tokens_per_image"], LIMITS["tokens_per_image"])}
    if thinking is not None:
        out["enable_thinking"] = thinking
    if pixels:
        out |= {"min_pixels": pixels[0], "max_pixels": pixels[1]}
    return out


def result_schema(specs: list[dict]) -> dict:
    """Name to hint, for key extraction."""
    return {s["name"]: s.get("format_hint") or s.get("example") or "" for s in specs}


MEMBERS = ["schema", "source", "document_classification", "raw_content", "field_candidates", "attention_field_matches", "unmapped_fields", "orphan_values", "entities", "relationships", "integrated_records", "review_issues"]


def document_prompt(hints: list[dict] | None = None, rules: str | None = None, grain: str = "page", language: str | None = None) -> str:
    """What a page model is asked: every visible value, hints only as hints, JSON with these members."""
    lines = [
        "Read this page completely and answer with one JSON object.",
        f"Members: {', '.join(MEMBERS)}.",
        "Report every visible label and value with the text that proves it; guess nothing, mark what is unreadable with [?].",
        f"Integrate records per {grain}.",
    ]
    if hints:
        lines.append("Pay attention to, but do not limit yourself to: " + "; ".join(h["name"] + (f" ({', '.join(h['aliases'][1:])})" if len(h.get("aliases") or []) > 1 else "") for h in hints))
    if rules:
        lines.append(f"Notes of the caller: {rules}")
    if language:
        lines.append(f"Answer in {language}.")
    return "\n".join(lines)


def field_prompt(spec: dict) -> str:
    parts = [f"Find the value of {spec['name']}."]
    for k, text in (("label_pattern", "Its label looks like"), ("position_hint", "It stands"), ("format_hint", "Its format is"), ("example", "For example"), ("context_rule", "It obeys")):
        if spec.get(k):
            parts.append(f"{text}: {spec[k]}.")
    if spec.get("allowed_values"):
        parts.append("One of: " + ", ".join(spec["allowed_values"]) + ".")
    return " ".join(parts)


def reading_prompt(kind: str = "document") -> str:
    """Asked before extraction: how the page is laid out, so that the next prompt can follow it."""
    return f"Read this {kind} as it is laid out: columns, tables, headings, labels with their values, stamps and handwriting. Describe the order in which it is to be read."


def adaptive_prompt(reading: str, specs: list[dict]) -> str:
    """Extraction that follows a reading made before."""
    return "\n".join(["The page reads like this:", reading, "Give these fields as JSON, each with value, confidence and the text that proves it:", *(field_prompt(s) for s in specs)])


def lossless_prompt(specs: list[dict] | None = None) -> str:
    """Everything on a page of the first version: text, tables, candidates, what is left over and what is uncertain."""
    lines = [
        "Write down this page without loss as one JSON object.",
        "Members: raw_markdown, raw_html, text_items, tables, field_candidates, mapped_fields, unmapped_fields, orphan_values, uncertain_tokens.",
        "Keep every visible text; mark what is unreadable with [?]; never make up a value.",
    ]
    return "\n".join(lines + [field_prompt(s) for s in specs or []])


def needs_model(request: str) -> bool:
    """Whether a request may only be made with a model: inspecting, preparing and looking after jobs need none."""
    return request not in ("inspect", "prepare", "jobs")


def second_pass_prompt(fields: list[dict]) -> str:
    return "Check each value against the page and correct single misread characters only.\n" + "\n".join(f"{f['name']}: {f.get('value', '')}" for f in fields)


#: What a preset asks for (fixed values): the type it takes a page for, then whether to make it grey, normalise, raise the contrast, sharpen, enhance edges.
PRESETS = {
    "light": ("scan", False, False, False, True, False),
    "aggressive": ("handwriting", True, True, True, True, True),
    "table": ("table", True, True, True, False, False),
    "handwriting": ("handwriting", False, True, True, True, True),
    "negative": ("scan", True, True, True, True, False),
    "scanned": ("scan", False, True, True, True, True),
}
#: Steps by type of document (fixed values): normalising, contrast (factor, offset), sharpening (sigma, m1, m2, x1, y2, y3), edges (scale).
TYPE_STEPS = {
    "table": (None, ("contrast(table-light 1.2)", 1.2, -15), ("sharpen(table sigma=0.5)", 0.5, 0.5, 0.2, 1.5, 6, 10), None),
    "photo": ("normalize(shadow-removal)", ("contrast(photo 1.4,-40)", 1.4, -40), ("sharpen(photo sigma=0.9)", 0.9, 0.9, 0.3, 2.0, 8, 12), None),
    "handwriting": ("normalize", ("contrast(handwriting 1.6,-50)", 1.6, -50), ("sharpen(handwriting sigma=1.1)", 1.1, 1.2, 0.4, 2.5, 10, 14), ("sobel-edge(handwriting)", 0.3)),
    "scan": ("normalize", ("contrast(1.35,-35)", 1.35, -35), ("sharpen(sigma=0.7)", 0.7, 0.7, 0.25, 1.8, 7, 10), ("sobel-edge(scan)", 0.2)),
}


def preset_steps(preset: str, inverted: bool = False, kind: str | None = None) -> list[str]:
    """The steps of a preset in their order; ``kind`` is a measured type in place of the preset's.

    An inverted page is turned round first, then taken for a scan whose edges stay as they are. Handwriting keeps its tones.
    """
    own, grey, normal, contrast, sharpen, edges = PRESETS[preset]
    kind = "scan" if inverted else kind or own
    steps = TYPE_STEPS[kind]
    out = ["invert(negative-detect)"] * inverted + ["auto-orient"] + ["grayscale"] * (grey and kind != "handwriting")
    asked = (normal and steps[0], contrast and steps[1][0], sharpen and steps[2][0], edges and not inverted and steps[3] and steps[3][0])
    return out + [x for x in asked if x]
