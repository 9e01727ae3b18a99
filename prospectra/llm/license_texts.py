"""Licences by SPDX identifier: what they are called, how their notices and their texts begin (fixed values)."""

from __future__ import annotations

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
_GNU_FILE = "GNU {} Version {} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = "Creative Commons {} {} International Public License. By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons {} {} International Public License"

#: Names; "Licensed under the {name}" is a notice of each.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "two-clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "three-clause BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2", "GPL 2", "GNU GPL 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3", "GPL 3", "GNU GPL 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPL 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3", "LGPL 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3", "AGPL 3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "EPL 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "WTFPL": ("WTFPL",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
} | {
    f"CC-{short}-{version}": (f"CC {short} {version}", f"Creative Commons {long} {version} {'International' if version == '4.0' else 'Unported'} License")
    for short, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for version in ("3.0", "4.0")
}

#: Headers of files, and how the licences themselves begin.
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    ),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, subject to the following conditions"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    *((spdx, form.format(name, version)) for spdx, name, version in (
        ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
    ) for form in (_GNU, _GNU_ONLY, _GNU_FILE)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    *((f"EPL-{v}", f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v{v} which accompanies this distribution") for v in ("1.0", "2.0")),
    *((f"EPL-{v}", f"Eclipse Public License - v {v} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").") for v in ("1.0", "2.0")),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is also available with a FAQ"),
    ("Artistic-2.0", "The Artistic License 2.0 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied"),
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights upon the creator"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"),
    *((spdx, _CC.format(names[1].split(" ")[2], "4.0", names[1].split(" ")[2], "4.0")) for spdx, names in NAMES.items() if spdx.startswith("CC-") and spdx.endswith("4.0")),
)

#: Forms in which a licence is named by its identifier.
IDENTIFIED = ("SPDX-License-Identifier: {}", "License: {}")

#: Words that turn a notice that follows them into its opposite (fixed values).
DENYING = frozenset({"not", "never", "isn", "cannot", "neither"})

#: Words that mean the same in notices.
SAME: dict[str, str] = {
    "released": "licensed", "distributed": "licensed", "available": "licensed", "published": "licensed", "offered": "licensed", "provided": "licensed",
    "licence": "license", "licences": "licenses", "creative": "cc", "commons": "cc", "attribution": "by", "noncommercial": "nc", "sharealike": "sa", "alike": "sa",
    "noderivatives": "nd", "two": "2", "three": "3", "simplified": "2", "new": "3", "zero": "0", "library": "lesser",
}

#: Words that part the licences of a family; versions do too.
PARTING: dict[str, frozenset[str]] = {
    "CC": frozenset({"by", "nc", "sa", "nd"}), "CC0": frozenset({"cc0"}), "GNU": frozenset({"lesser", "affero", "lgpl", "agpl"}), "BSD": frozenset({"neither", "endorse", "0bsd", "0"}),
    "MIT": frozenset({"0"}), "ISC": frozenset({"appear"}), "0BSD": frozenset({"appear", "bsd"}),
}


def family(spdx: str) -> str:
    return {"GPL": "GNU", "LGPL": "GNU", "AGPL": "GNU"}.get(spdx.split("-")[0], spdx.split("-")[0])
