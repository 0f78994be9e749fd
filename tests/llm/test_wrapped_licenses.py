"""License notices that are wrapped over several lines."""

import textwrap

import pytest

from logsieve.llm import licenses as L

NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


@pytest.mark.parametrize("before", [0, 50, 1000])
def test_wrapped_notices_are_found(table, before):
    lead = "\n".join(["some other words here"] * before)
    rows = [(k, f"{lead}\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width)) + "\nand more\n")
            for k, (t, width) in enumerate((t, w) for _, t in NOTICES for w in (40, 72))]
    got = {r.doc_id: (r.labels, r.score) for r in L.find_licenses(table(rows)).collect()}
    for k, (label, _) in enumerate(n for n in NOTICES for _ in range(2)):
        assert label in got[k][0] and got[k][1] == 1.0


def test_what_lines_hold_is_not_lost(table):
    """A line that the windows over the whole text cut in two is still a block of its own."""
    spread = " ".join(f"{w} zed zed" for w in L.TEMPLATES[1][1].split())
    text = "zed " * 21 + "\n" + spread
    assert [r.labels for r in L.find_licenses(table([(1, text)])).collect()] == [["mit"]]
