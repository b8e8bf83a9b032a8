"""Profiles of read-only accounts: a JSON file with a strict schema, selection by id or by what is unambiguous."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from pathlib import Path

from ..validate import InvalidArgument, need

PRODUCTS, ENVIRONMENTS = ("spot", "futures"), ("production", "testnet")


@dataclass(frozen=True)
class Profile:
    id: str
    product: str
    environment: str
    api_key: str
    private_key_path: str
    default: bool = False

    def status(self) -> dict:
        """Without the key and the path of the private one."""
        return {"profileId": self.id, "product": self.product, "environment": self.environment, "isDefault": self.default}


def parse(record: dict) -> Profile:
    known = {f.name: f for f in fields(Profile)}
    need(isinstance(record, dict) and not set(record) - set(known), "profile: unknown fields")
    try:
        out = Profile(**record)
    except TypeError as e:
        raise InvalidArgument("profile: fields are missing") from e
    text = [out.id, out.product, out.environment, out.api_key, out.private_key_path]
    need(all(isinstance(x, str) and x for x in text) and isinstance(out.default, bool), "profile: a field has a wrong type")
    need(bool(re.fullmatch(r"[A-Za-z0-9_-]{1,64}", out.id)), "profile: bad id")
    need(out.product in PRODUCTS and out.environment in ENVIRONMENTS, "profile: unknown product or environment")
    need(Path(out.private_key_path).is_absolute(), "profile: the key's path must be absolute")
    return out


class ProfileStore:
    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> list[Profile]:
        if not self.path.exists():
            return []
        records = json.loads(self.path.read_text())
        need(isinstance(records, list), "profiles: a list is needed")
        out = [parse(r) for r in records]
        need(len({p.id for p in out}) == len(out), "profiles: an id is there twice")
        for product in PRODUCTS:
            need(sum(p.default for p in out if p.product == product) <= 1, f"profiles: more than one default for {product}")
        return out

    def select(self, product: str, profile_id: str | None = None) -> Profile:
        """The named profile, or the product's default, or its only one."""
        fit = [p for p in self.load() if p.product == product and profile_id in (None, p.id)]
        chosen = [p for p in fit if p.default] or fit if profile_id is None else fit
        need(len(chosen) == 1, "profile: none fits" if not chosen else "profile: more than one fits, name one")
        return chosen[0]

    def status(self) -> list[dict]:
        return [p.status() for p in self.load()]
