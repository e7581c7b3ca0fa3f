"""Licence notices wrapped over lines, in words that NOTICES doesn't hold whole."""

import textwrap

import pytest

pytest.importorskip("sievemark.llm.queries")

from sievemark.llm import license  # noqa: E402

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice"
ISC = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."


def test_wrapped_notices(spark):
    plain = "the river ran past the old mill\nand nobody came to see it"
    rows, want = [], {}
    for k, (name, notice) in enumerate([("mit", MIT), ("bsd", BSD), ("isc", ISC), ("gpl", GPL)]):
        for at, (width, mark) in enumerate([(72, ""), (60, "# "), (45, " * ")]):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(notice, width))
            rows += [(10 * k + at, f"{plain}\n\nCopyright 2021 someone. All rights reserved.\n{mark.strip()}\n{wrapped}\n\n{plain}")]
            want[10 * k + at] = name
    rows += [(100, f"{plain}\n\nAll rights reserved.\n{plain}"), (101, plain)]
    want |= {100: "proprietary", 101: "none"}
    # Background enough that words of the notices stay rare in it.
    rows += [(1000 + k, f"the river ran past mill {k} of the valley\nand {k} people came to see it") for k in range(4000)]
    got = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id < 1000").collect()}
    assert {i: r.license for i, r in got.items()} == want and all(got[i].confirmed for i in want if i < 101)
