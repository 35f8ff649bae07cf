"""Prompt templates as data: name, system or user, and text with {fields}. A template knows its fields, and none is filled twice."""

from __future__ import annotations

from string import Formatter

TEMPLATES: dict[str, str] = {
    "judge_system": "You check statements about a person against a reference of facts. Use nothing but the reference.",
    "judge": "Reference:\n{reference}\n\nStatement:\n{text}\n\nIs the statement Supported, Not Supported or Not Addressed by the reference? Supported: all of it follows from the reference. Not Supported: some of it contradicts the reference. Not Addressed: the reference doesn't tell. Answer in JSON with the keys verdict and reason.",
    "judge_reasoning": "Reference:\n{reference}\n\nStatement:\n{text}\n\nThink step by step whether the statement is Supported, Not Supported or Not Addressed by the reference. Close with the verdict and one reason.",
    "judge_from_reasoning": "Below is a chain of thought about a statement, with its final answer.\n\n{chain}\n\nGive the verdict (Supported, Not Supported or Not Addressed) and its reason in JSON with the keys verdict and reason.",
    "explain": "These are the reasons why statements were judged {label}:\n{reasons}\n\nSum them up in a few sentences.",
    "claims_system": "You take texts apart into the claims that they make.",
    "claims_contains": "Does this text make any claim that can be true or false?\n\n{text}\n\nAnswer in JSON with the key contains_claim, true or false.",
    "claims_list": "List every claim of this text, each as one short sentence that can be understood alone.\n\n{text}\n\nAnswer in JSON with the key claims, a list of strings.",
    "validity_system": "You check whether a text is a statement that can be verified.",
    "validity_imperative": "Does this text give an order or a recommendation rather than state something?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "validity_interrogative": "Is this text a question?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "validity_incomplete": "Is this text incomplete, so that it states nothing?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "validity_vague": "Does this text leave open whom or what it is about?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "validity_empty": "Does this text lack all content?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "validity_invalid": "Taken as a whole, is this text unfit to be verified as a statement?\n\n{text}\n\nAnswer in JSON with the key answer, true or false.",
    "writer_system": "You write the course of a hospital stay from its notes.",
    "writer_summarize": "Sum up this note in at most {limit} words. Keep what matters for the course of the stay.\n\n{text}",
    "writer_combine": "Combine these summaries into one, in order of time, in at most {limit} words.\n\n{text}",
    "writer_brief": "Write the course of the stay in at most {limit} words from these summaries.\n\n{text}",
    "writer_refine": "This is the course of the stay so far:\n{before}\n\nTake in what these later summaries add, in at most {limit} words.\n\n{text}",
    "writer_compact": "Shorten this course of the stay to at most {limit} words without losing findings.\n\n{text}",
    "json_repair": "This should be JSON of the form {schema}:\n{text}\n\nGive it as valid JSON and nothing else.",
}
VALIDITY = ("imperative", "interrogative", "incomplete", "vague", "empty", "invalid")


def fields(name: str) -> set[str]:
    return {f for _, f, _, _ in Formatter().parse(TEMPLATES[name]) if f}


def prompt(name: str, **values: object) -> str:
    """The filled template; values are put in as they are, braces and all."""
    if missing := fields(name) - set(values):
        raise KeyError(f"{name} lacks {sorted(missing)}")
    return "".join(text + (str(values[field]) if field else "") for text, field, _, _ in Formatter().parse(TEMPLATES[name]))
