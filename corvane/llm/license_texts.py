"""Licence notices as they are published, by SPDX identifier. Covered are the licences named here and no others."""

#: Versions of the GNU licences that a line may name: name in a line, SPDX prefix, versions.
GNU = [
    ("General Public License", "GPL", ["1.0", "2.0", "3.0"]),
    ("Library General Public License", "LGPL", ["2.0"]),
    ("Lesser General Public License", "LGPL", ["2.1", "3.0"]),
    ("Affero General Public License", "AGPL", ["1.0", "3.0"]),
    ("Free Documentation License", "GFDL", ["1.1", "1.2", "1.3"]),
]
#: Versions and kinds of the Creative Commons licences: letters, words.
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
CC_KINDS = [
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]

#: Identifiers whose tags are known. A tag of "only" or "or later" is the identifier's tag and more.
TAGS = [
    "MIT", "ISC", "Zlib", "Unlicense", "CC0-1.0", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-1.0", "MPL-1.1", "MPL-2.0",
    *[f"{short}-{v}" for _, short, versions in GNU for v in versions], *[f"CC-{kind}-{v}" for kind, _ in CC_KINDS for v in CC_VERSIONS],
]

#: One-line notices, marks and tags.
LINES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    *[(f"{short}-{v}", f"{lead} under the GNU {name}, version {v.removesuffix('.0')}.") for name, short, versions in GNU for v in versions for lead in ("This work is licensed", "Licensed")],
    ("BSD-4-Clause", "Licensed under the BSD 4-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MIT", "The MIT License"),
    *[(f"BSD-{n}-Clause", f"BSD {n}-Clause License") for n in (2, 3, 4)],
    *[(f"Apache-{v}", f"Apache License, Version {v}") for v in ("1.1", "2.0")],
    *[(f"{short}-{v}", mark) for name, short, versions in GNU for v in versions for mark in (f"GNU {name}, version {v.removesuffix('.0')}", f"GNU {name} v{v.removesuffix('.0')}", f"GNU {short} version {v.removesuffix('.0')}", f"GNU {short} v{v.removesuffix('.0')}")],
    *[(short, f"SPDX-License-Identifier: {short}") for short in TAGS],
    *[(f"MPL-{v}", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}.") for v in ("1.0", "1.1", "2.0")],
    *[(f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for kind, _ in CC_KINDS for v in CC_VERSIONS],
    *[(f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {words} {v} International License.") for kind, words in CC_KINDS for v in CC_VERSIONS],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: What several notices have in common.
AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
PROGRAM = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free
Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU {name} for more details."""

#: Longer notices.
NOTICES = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    *[(f"{short}-{v}", PROGRAM.format(name=name, version=v.removesuffix(".0"))) for name, short, versions in GNU[:4] for v in versions],
    ("BSD-2-Clause", f"{BSD_2} {AS_IS}"),
    ("BSD-3-Clause", f"{BSD_2} {BSD_3} {AS_IS}"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org""",
    ),
]
TEMPLATES = LINES + NOTICES

#: Words that tell one licence from another of nearly the same wording.
TELLING = ["lesser", "library", "affero", "documentation", "sa", "nd", "nc", "sharealike", "noderivatives", "noderivs", "noncommercial"]
#: Words after which a number is a version (or the number of a BSD licence's clauses).
BEFORE_VERSION = ["version", "v", "gpl", "lgpl", "agpl", "gfdl", "mpl", "by", "sa", "nd", "nc", "attribution", "sharealike", "noderivatives", "noderivs", "noncommercial", "bsd"]
#: Short names of what a telling word says, and words before a notice that take it back.
SHORT = {"lgpl": "lesser", "agpl": "affero", "gfdl": "documentation"}
DENIALS = ["not", "never", "nor", "neither"]
