"""License headers as they stand in real files, wrapped and commented."""

from __future__ import annotations

from reelspark.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version.
"""
BSD = """Copyright (c) somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
TEXTS = {
    MIT: "MIT", APACHE: "Apache-2.0", GPL3: "GPL-3.0-or-later", GPL2: "GPL-2.0-or-later", BSD: "BSD-2-Clause", BSD + NAMES: "BSD-3-Clause",
    "This project is licensed under the MIT License.": "MIT", "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x": "GPL-3.0-or-later",
    GPL3 + "\n\nLicensed under the GNU General Public License, version 3.": "GPL-3.0-or-later", "Released under the Frobnicate Terms.": "LicenseRef-unknown", "A license plate.": "", MIT + "\n\n" + GPL2: "GPL-2.0-or-later,MIT",
}


def test_headers(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, MIT), (0, "none"), (0, "none")], "doc_id long, text string")
    got = sorted((r.id if r.id is not None else -1, r.licenses) for r in licenses.license_scan(docs).collect())
    assert got == sorted([*enumerate(TEXTS.values()), (-1, "MIT"), (0, ""), (0, "")])
