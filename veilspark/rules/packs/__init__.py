"""Bundled rule packs, in load order."""

from . import commercial, internal, noise, pii, secrets

BUNDLED = (commercial.PACK, internal.PACK, noise.PACK, pii.PACK, secrets.PACK)
