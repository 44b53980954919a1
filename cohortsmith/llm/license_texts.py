"""License phrases, and license wording with its regions marked."""

from __future__ import annotations

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_YEARS_AND_HOLDER = '<<var;name="copyright";words="0-40">>'

_WARRANTY_OF_HOLDERS = """
THIS SOFTWARE IS PROVIDED BY <<var;name="who";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_BSD_FIRST_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
<<var;name="bullet";words="0-1">> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
<<var;name="bullet";words="0-1">> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
"""

TEMPLATES = [
    ("mit", f"""
<<beginOptional>>The <<endOptional>><<beginOptional>>MIT License <<beginOptional>>(MIT)<<endOptional>>
{_YEARS_AND_HOLDER}<<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next
paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="liable";words="1-20">> BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", """
<<beginOptional>>This <<var;name="work";words="1-4">> is <<endOptional>>
Released under the <<beginOptional>>terms of the <<endOptional>>MIT License"""),
    ("isc", f"""
<<beginOptional>>ISC License {_YEARS_AND_HOLDER}<<endOptional>>
Permission to use, copy, modify, <<beginOptional>>and/or <<endOptional>>
<<beginOptional>>and <<endOptional>>distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in
all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";words="1-20">> DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd-2-clause", _BSD_FIRST_CLAUSES + _WARRANTY_OF_HOLDERS),
    ("bsd-3-clause", _BSD_FIRST_CLAUSES + """
<<var;name="bullet";words="0-1">> Neither the name of <<var;name="holder";words="1-20">> nor the
names of <<var;name="its";words="1-2">> contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
""" + _WARRANTY_OF_HOLDERS),
    ("apache-2.0", """
Licensed under the Apache License, Version 2.0
<<beginOptional>>(the "License"); you may not use this <<var;name="file";words="1-3">> except in
compliance with the License. You may obtain a copy of the License at
<<var;name="address";words="1-12">> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied.<<endOptional>>"""),
    ("gpl-2.0", """
<<beginOptional>>This <<var;name="work";words="1-4">> is <<endOptional>>
licensed under the <<beginOptional>>terms of the <<endOptional>>
GNU General Public License<<beginOptional>> as published by the Free Software
Foundation<<endOptional>>, version 2<<beginOptional>>.0<<endOptional>>"""),
    ("gpl-3.0", """
<<beginOptional>>This <<var;name="work";words="1-4">> is <<endOptional>>
licensed under the <<beginOptional>>terms of the <<endOptional>>
GNU General Public License<<beginOptional>> as published by the Free Software
Foundation<<endOptional>>, version 3<<beginOptional>>.0<<endOptional>>"""),
    ("gpl-notice", """
This <<var;name="program";words="1-6">> is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation,
<<beginOptional>>either <<endOptional>>version <<var;name="version";words="1-2";match="[0-9]+">>
<<beginOptional>>of the License<<endOptional>>
<<beginOptional>>, or (at your option) any later version<<endOptional>>."""),
    ("lgpl-notice", """
This <<var;name="library";words="1-6">> is free software: you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License as published by the Free Software
Foundation, <<beginOptional>>either <<endOptional>>version
<<var;name="version";words="1-2";match="[0-9]+">> <<beginOptional>>of the License<<endOptional>>
<<beginOptional>>, or (at your option) any later version<<endOptional>>."""),
    ("mpl-2.0", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at
<<var;name="address";words="1-8">>."""),
    ("unlicense", """
This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    *[(f"cc-{kind}", f"""
<<beginOptional>>This <<var;name="work";words="1-4">> is <<endOptional>>
licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>
<<beginOptional>>Creative Commons <<endOptional>>CC {kind.replace("-", " ")}
<<var;name="version";words="2-2";match="[0-9]">>""")
      for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")],
    *[(label, f"""
<<beginOptional>>This <<var;name="work";words="1-4">> is <<endOptional>>
licensed under a Creative Commons {name}
<<var;name="version";words="2-2";match="[0-9]">>
<<var;name="port";words="1-2">> License""")
      for label, name in (
          ("cc-by", "Attribution"), ("cc-by-sa", "Attribution-ShareAlike"),
          ("cc-by-nc", "Attribution-NonCommercial"),
          ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike"))],
    ("spdx", """
SPDX-License-Identifier: <<var;name="identifier";words="1-1">>"""),
]
