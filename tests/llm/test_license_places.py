"""Licences that are wrapped, stand in long lines, or stand beside others."""

import random
import textwrap

import pytest

from noticelake.llm import license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy and modify."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."


def families(text):
    return {f for _, f, _ in license_scan.scan(text)}


@pytest.mark.parametrize(("text", "family"), [(MIT, "mit"), (BSD, "bsd"), (LGPL, "lgpl")])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_texts(text, family, mark):
    for width in (20, 40, 75):
        lines = [mark + x for x in textwrap.wrap(text, width)]
        (line, found, _), = license_scan.scan("\n".join(["intro", "", *lines, "", "end"]))
        assert found == family and (line == 2 or family == "lgpl")  # lgpl has no template of the grant, only of its name
        assert families("\n".join(lines)) == {family}


def test_every_phrase_in_a_long_line():
    rng = random.Random(5)
    filler = [f"{a}{b}" for a in ("sto", "gar", "hou", "win") for b in ("ne", "den", "se", "dow")]
    for family, phrases in license_scan.TEMPLATES.items():
        for phrase in phrases:
            before, after = ([rng.choice(filler) for _ in range(400)] for _ in range(2))
            assert families(" ".join([*before, phrase, *after])) == {family}, phrase


def test_several_licences():
    assert families("Licensed under the Apache License, Version 2.0, or released under the MIT License.") == {"apache-2.0", "mit"}
    assert families("Licensed under the GNU Lesser General Public License, version 3") == {"lgpl"}
    assert families("Licensed under CC BY-SA 4.0.") == {"cc-by-sa"}
    twice = license_scan.scan("Released under the MIT License.\nAll rights reserved.\n\nReleased under the MIT License.")
    assert [x[:2] for x in twice] == [(0, "mit"), (1, "proprietary"), (3, "mit")]


def test_a_short_phrase_by_share():
    assert families("This work is licensed under a GNU General Public License, version 3") == {"gpl"}
    assert families("the license of the house was under the bridge and the version of the public license 2.0") == set()


def test_identifiers_and_names():
    for text, family in [
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: ISC", "isc"),
        ("MIT License", "mit"), ('BSD 2-Clause "Simplified" License', "bsd"), ("ISC License", "isc"),
    ]:
        assert families(text) == {family}, text
    assert families("SPDX-License-Identifier: Zlib") == set()


def test_the_classifier_passes_no_agreeing_text_over():
    """What agrees with a template gets a look, whatever stands around it and whatever words it lacks."""
    rng = random.Random(9)
    filler = "the of and a to in is for that with stone garden window house river".split()
    for family, phrases in license_scan.TEMPLATES.items():
        for phrase in phrases:
            words = phrase.split()
            for share in (1.0, 0.9, 0.8):
                kept = [w for w in words if rng.random() < share]
                text = [rng.choice(filler) for _ in range(rng.randrange(60))] + kept + [rng.choice(filler) for _ in range(rng.randrange(60))]
                if any(f == family for _, _, f in license_scan.windows(text)):
                    assert license_scan.promising([text]) == [True], (family, kept)


def test_prose_is_unknown_and_ties_and_steps_change_nothing():
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 80))) for _ in range(300)]
    assert not any(license_scan.scan_all(prose))
    texts = ["", MIT, "x\n\n" + BSD, prose[0], "MIT License MIT License", MIT + "\n" + MIT, " \n\n ", "word " * 60_000 + "MIT License"]
    assert list(license_scan.scan_all(texts * 2)) == [license_scan.scan(t) for t in texts] * 2
    assert license_scan.scan("MIT License MIT License")[0][:2] == (0, "mit") and len(license_scan.scan(texts[-1])) == 1
