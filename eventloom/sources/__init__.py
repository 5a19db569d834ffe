"""Landed feeds to cards. Input columns are those of `schemas.LANDED`."""
