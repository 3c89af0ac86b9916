"""Licence notices that are wrapped, commented, or several in a sentence."""

import random
import textwrap

from vigil.llm import license_scan

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
       "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
       "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
       "Software is furnished to do so, subject to the following conditions:")
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
       "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
       "following disclaimer.")
APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
          "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
       "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
LGPL = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
       "provided that the above copyright notice and this permission notice appear in all copies.")
NOTICES = {"mit": MIT, "bsd": BSD, "apache": APACHE, "gpl": GPL, "lgpl": LGPL, "isc": ISC}
SIGNS = ("", "# ", " * ", "// ")
STORY = "the old man walked to the river and looked at the boats of the town in the evening light of a long day".split()


def story(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(STORY) for _ in range(12)) for _ in range(n)]


def test_wrapped_notices(spark):
    rows, want = [], {}
    for family, text in NOTICES.items():
        for width in (60, 72, 80):
            for sign in SIGNS:
                doc_id = len(rows)
                lines = [sign + line for line in textwrap.wrap(text, width)]
                before, after = story(doc_id, doc_id % 7), story(-doc_id - 1, doc_id % 5)
                rows.append((doc_id, "\n".join(before + lines + after)))
                want[doc_id] = family
    rows.append((None, rows[0][1]))
    rows += [(1000 + k, "\n".join(story(k + 99, 40))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.find_licenses(df).cache()
    got = {r.doc_id: r for r in license_scan.per_document(df, found).collect()}
    missed = {k: (f, got[k].families) for k, f in want.items() if f not in got[k].families.split(",")}
    assert not missed
    others = {k: (f, got[k].families) for k, f in want.items() if got[k].families != f}
    assert not others
    assert got[None].families == "mit"
    assert all(got[1000 + k].n_confirmed == 0 for k in range(20))
    runs = found.where("n_lines > 1")
    assert runs.count() > 0 and runs.where("not confirmed").count() == 0


def test_several_families_and_close_relatives(spark):
    rows = [(1, "Dual licensed under the MIT license and the GNU General Public License version 2."),
            (2, "This work is licensed under CC BY-NC-SA 4.0."), (3, "Licensed under CC BY-ND 4.0."),
            (4, "Licensed under the Eclipse Public License, version 2.0."), (5, "Licensed under CC BY-SA 4.0."),
            (6, "Licensed under the GNU Lesser General Public License, version 2.1."), (7, "In no event will the authors come."),
            (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.per_document(df, license_scan.find_licenses(df)).collect()}
    assert got == {1: "gpl,mit", 2: "cc-by-nc-sa", 3: "cc-by-nd", 4: "epl", 5: "cc-by-sa", 6: "lgpl", 7: "", 8: "", 9: ""}


def test_all_ordinary_lines_teach_the_model(spark):
    texts = [f"{' '.join(story(k, 1))} chapter {k}" + (" of this software\nshort line\nA copyright line that is no ordinary one." if k % 9 == 0 else "")
             for k in range(9000)]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, None)], "doc_id long, text string").repartition(4)
    seen = {}

    def keep(sets, vocabulary, *rest):
        seen["rows"], seen["vocabulary"] = sets.collect(), vocabulary
        return train(sets, vocabulary, *rest)

    train, license_scan.train = license_scan.train, keep
    try:
        found = license_scan.find_licenses(df)
        assert found.where("confirmed").count() == 0
    finally:
        license_scan.train = train
    assert sum(r.n for r in seen["rows"]) == 9001
    ours = seen["vocabulary"].index("this software")
    assert sum(r.n for r in seen["rows"] if ours in r.ks) == 1000
    assert {r.held for r in seen["rows"]} == {True, False} and all(r.n > 0 for r in seen["rows"])
