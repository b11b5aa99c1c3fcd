"""Questionnaires in the FHIR R4 exchange format, read into tables and written from them."""

from __future__ import annotations

import json

# Item types of the exchange format and the question types they stand for.
_IN = {"choice": "single_choice", "open-choice": "sata_other", "boolean": "boolean", "decimal": "numeric", "integer": "numeric", "quantity": "numeric", "string": "text", "text": "text", "date": "date", "dateTime": "datetime"}
_OUT = {"single_choice": "choice", "multiple_choice": "choice", "likert": "choice", "ranked": "choice", "sata_other": "open-choice", "boolean": "boolean", "numeric": "decimal", "slider": "decimal", "text": "text", "date": "date", "datetime": "dateTime", "grid": "group", "repeating_group": "group"}
_MIN, _MAX = "http://hl7.org/fhir/StructureDefinition/minValue", "http://hl7.org/fhir/StructureDefinition/maxValue"
_CONTROL = "http://hl7.org/fhir/StructureDefinition/questionnaire-itemControl"


def _control(item: dict) -> set[str]:
    return {c.get("code") for e in item.get("extension", []) if e.get("url") == _CONTROL for c in e.get("valueCodeableConcept", {}).get("coding", [])}


def _bound(item: dict, url: str) -> float | None:
    for e in item.get("extension", []):
        if e.get("url") == url:
            return next((float(v) for k, v in e.items() if k.startswith("value")), None)
    return None


def _type(item: dict) -> str | None:
    """Question type of an item; plain groups and items that ask nothing have none."""
    kind, control = item.get("type"), _control(item)
    if kind == "group":
        return "grid" if "gtable" in control else "repeating_group" if item.get("repeats") else None
    if kind == "choice" and item.get("repeats"):
        return "multiple_choice"
    if kind in ("integer", "decimal") and "slider" in control:
        return "slider"
    return _IN.get(kind)


def read_questionnaire(resource: dict | str) -> dict[str, list[dict]]:
    """Rows of questionnaire, question, response_option, questionnaire_question and skip_rule.

    Plain groups are dissolved, their items keep their order. Value sets contained in the resource are looked up. A gate
    (enableWhen) becomes one rule an entry, its answer as text; ``exists: false`` becomes ``not_exists``.
    """
    r = json.loads(resource) if isinstance(resource, str) else resource
    if r.get("resourceType") != "Questionnaire":
        raise ValueError("not a Questionnaire")
    sets = {"#" + v["id"]: [c for i in v.get("compose", {}).get("include", []) for c in i.get("concept", [])] for v in r.get("contained", []) if v.get("resourceType") == "ValueSet"}
    out: dict[str, list[dict]] = {n: [] for n in ("question", "response_option", "questionnaire_question", "skip_rule")}
    out["questionnaire"] = [{"questionnaire_id": 1, "name": r.get("title") or r.get("name") or "", "version": str(r.get("version", "1.0")), "canonical_url": r.get("url"), "fhir_status": r.get("status", "draft")}]
    ids: dict[str, int] = {}
    gates: list[tuple[int, dict]] = []

    def add(items: list[dict], parent: int | None) -> None:
        for item in items:
            kind = _type(item)
            if kind is None:
                add(item.get("item", []), parent)
                continue
            n = len(out["question"]) + 1
            ids[item["linkId"]] = n
            out["question"].append({"question_id": n, "link_id": item["linkId"], "question_text": item.get("text", ""), "question_type": kind, "numeric_min": _bound(item, _MIN), "numeric_max": _bound(item, _MAX)})
            out["questionnaire_question"].append({"qq_id": n, "questionnaire_id": 1, "question_id": n, "display_order": n - 1, "parent_qq_id": parent, "is_required": int(bool(item.get("required")))})
            options = [o.get("valueCoding") or {"code": str(o.get("valueString", o.get("valueInteger")))} for o in item.get("answerOption", [])] + sets.get(item.get("answerValueSet", ""), [])
            for place, o in enumerate(options):
                out["response_option"].append({"option_id": len(out["response_option"]) + 1, "question_id": n, "option_text": o.get("display") or o.get("code"), "option_value": o.get("code"), "display_order": place})
            gates.extend((n, item | {"_when": w}) for w in item.get("enableWhen", []))
            add(item.get("item", []), n)

    add(r.get("item", []), None)
    for n, item in gates:
        w = item["_when"]
        answer = next((v for k, v in w.items() if k.startswith("answer")), None)
        missing = w.get("operator") == "exists" and answer is False
        text = answer.get("code") if isinstance(answer, dict) else str(answer).lower() if isinstance(answer, bool) else None if answer is None else str(float(answer)) if isinstance(answer, (int, float)) else str(answer)
        out["skip_rule"].append({"rule_id": len(out["skip_rule"]) + 1, "qq_id": n, "enable_behavior": item.get("enableBehavior", "any"), "trigger_qq_id": ids.get(w.get("question")), "operator": "not_exists" if missing else w.get("operator"), "trigger_value": None if w.get("operator") == "exists" else text})
    return out


def write_questionnaire(tables: dict[str, list[dict]]) -> dict:
    """The exchange form of tables as :func:`read_questionnaire` gives them; reading it again gives the same questions, options and placements."""
    head = tables["questionnaire"][0]
    questions = {q["question_id"]: q for q in tables["question"]}
    options: dict[int, list[dict]] = {}
    for o in sorted(tables.get("response_option", []), key=lambda o: o["display_order"]):
        options.setdefault(o["question_id"], []).append({"valueCoding": {"code": o["option_value"], "display": o["option_text"]}})
    links = {p["qq_id"]: questions[p["question_id"]]["link_id"] for p in tables["questionnaire_question"]}
    rules: dict[int, list[dict]] = {}
    for w in tables.get("skip_rule", []):
        if w["trigger_qq_id"] in links:
            rules.setdefault(w["qq_id"], []).append(w)

    def build(parent: int | None) -> list[dict]:
        out = []
        for p in sorted((p for p in tables["questionnaire_question"] if p.get("parent_qq_id") == parent), key=lambda p: p["display_order"]):
            q = questions[p["question_id"]]
            item: dict = {"linkId": q["link_id"], "text": q["question_text"], "type": _OUT[q["question_type"]]}
            extension = [{"url": u, "valueDecimal": q[c]} for u, c in ((_MIN, "numeric_min"), (_MAX, "numeric_max")) if q.get(c) is not None]
            control = {"slider": "slider", "grid": "gtable"}.get(q["question_type"])
            if control:
                extension.append({"url": _CONTROL, "valueCodeableConcept": {"coding": [{"code": control}]}})
            if extension:
                item["extension"] = extension
            if q["question_type"] in ("multiple_choice", "repeating_group"):
                item["repeats"] = True
            if p.get("is_required"):
                item["required"] = True
            if held := options.get(q["question_id"]):
                item["answerOption"] = held
            if gate := rules.get(p["qq_id"]):
                item["enableWhen"] = [{"question": links[w["trigger_qq_id"]], "operator": "exists" if "exists" in w["operator"] else w["operator"]} | ({"answerBoolean": w["operator"] == "exists"} if "exists" in w["operator"] else {"answerString": w["trigger_value"]}) for w in gate]
                item["enableBehavior"] = gate[0]["enable_behavior"]
            if below := build(p["qq_id"]):
                item["item"] = below
            out.append(item)
        return out

    return {"resourceType": "Questionnaire", "url": head["canonical_url"], "version": head["version"], "title": head["name"], "status": head.get("fhir_status", "draft"), "item": build(None)}
