"""Whole sentences of published licences and their notices, normalised, and the rules over them.

In a sentence with a holder's name, the name is "the holder" (see ``SLOTS``).
"""

#: Sentences as the licences' publishers wrote them.
PUBLISHED = {
    "mit-full-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions"
    ),
    "mit-full-as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement"
    ),
    "mit-full-liable": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-text-1": (
        "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this "
        "document"
    ),
    "apache-text-2": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "gpl-3.0-text-1": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-3.0-text-2": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "gpl-2.0-text-1": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl-2.0-text-2": (
        "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure "
        "the software is free for all its users"
    ),
    "lgpl-2.1-text-1": "this is the first released version of the lesser gpl",
    "lgpl-2.1-text-2": "it also counts as the successor of the gnu library public license version 2 hence the version number 2 1",
    "lgpl-3.0-text-1": (
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public "
        "license supplemented by the additional permissions listed below"
    ),
    "mpl-2.0-text-1": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl-2.0-text-2": (
        "contributor version means the combination of the contributions of others if any used by a contributor and that particular "
        "contributor s contribution"
    ),
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v",
    "cc0-1.0-text-1": (
        "certain owners wish to permanently relinquish those rights to a work for the purpose of contributing to a commons of creative "
        "cultural and scientific works commons that the public can reliably and without fear of later claims of infringement build upon "
        "modify incorporate in other works reuse and redistribute as freely as possible in any form whatsoever and for any purposes "
        "including without limitation commercial purposes"
    ),
    "cc0-1.0-text-2": (
        "these owners may contribute to the commons to promote the ideal of a free culture and the further production of creative cultural "
        "and scientific works or to gain reputation or greater distribution for their work in part through the use and efforts of others"
    ),
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means"
    ),
    "zlib-1": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions"
    ),
    "zlib-2": "the origin of this software must not be misrepresented",
    "bsl-1.0-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
        "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the "
        "following"
    ),
    "bsl-1.0-2": (
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the "
        "following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software "
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language "
        "processor"
    ),
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-grant": (
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies"
    ),
    "isc-grant-or": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution"
    ),
    "bsd-names": (
        "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission"
    ),
    "bsd-as-is": (
        "this software is provided by the holder and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ),
    "library-free": "this library is free software",
    "lgpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation"
    ),
    "agpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation"
    ),
    "later-2": "either version 2 of the license or at your option any later version",
    "later-2.1": "either version 2 1 of the license or at your option any later version",
    "later-3": "either version 3 of the license or at your option any later version",
    "gpl-2.0-later": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version"
    ),
    "gpl-3.0-later": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version"
    ),
    "lgpl-2.1-later": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 2 1 of the license or at your option any later version"
    ),
    "lgpl-3.0-later": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"
    ),
    "agpl-3.0-later": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"
    ),
    "gpl-2.0-only": (
        "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free "
        "software foundation"
    ),
    "cc-by-4.0-a": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-4.0-the": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-nc-4.0-a": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-4.0-the": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc-by-sa-4.0-a": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-sa-4.0-the": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-nd-4.0-a": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nd-4.0-the": "this work is licensed under the creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-4.0-a": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-sa-4.0-the": "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-4.0-a": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "cc-by-nc-nd-4.0-the": "this work is licensed under the creative commons attribution noncommercial noderivatives 4 0 international license",
}

#: What stands before, for and after a holder's name.
SLOTS = (("neither the name of ", "the holder", " nor the names of"), ("this software is provided by ", "the holder", " and contributors as is"))

#: Licence rules, full texts first, then headers; tried before those of the notices.
PUBLISHED_RULES = (
    ("Apache-2.0", ("apache-text-1", "apache-text-2")),
    ("LGPL-3.0", ("lgpl-3.0-text-1",)),
    ("LGPL-2.1", ("lgpl-2.1-text-1", "lgpl-2.1-text-2")),
    ("GPL-3.0", ("gpl-3.0-text-1", "gpl-3.0-text-2")),
    ("GPL-2.0", ("gpl-2.0-text-1", "gpl-2.0-text-2")),
    ("MPL-2.0", ("mpl-2.0-text-1", "mpl-2.0-text-2")),
    ("CC0-1.0", ("cc0-1.0-text-1", "cc0-1.0-text-2")),
    ("MIT", ("mit-full-grant", "mit-keep")),
    ("BSD-3-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-terms", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-or",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("Zlib", ("zlib-1", "zlib-2")),
    ("BSL-1.0", ("bsl-1.0-1", "bsl-1.0-2")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("MPL-2.0", ("mpl-2.0-header",)),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-3.0-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "later-3")),
    ("LGPL-3.0-or-later", ("lgpl-3.0-later",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "later-3")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-later",)),
    ("LGPL-2.1-or-later", ("lgpl-terms", "later-2.1")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3.0-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "later-3")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-2.0-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "later-2")),
    ("GPL-2.0-only", ("gpl-free", "gpl-2.0-only")),
    *((f"CC-{kind}-4.0", (f"cc-{kind.lower()}-4.0-{article}",)) for kind in ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for article in ("a", "the")),
)
