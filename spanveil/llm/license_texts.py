"""Licence notices by family: what the classifier learns from and its predictions are compared with."""

#: Public notices and opening passages, one string a notice.
FAMILIES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0 for non-commercial use only.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0 Universal public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document contains confidential and proprietary information and may not be copied or disclosed.",
    ),
}

#: The licences' own titles, which the fit reads too.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("The MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "BSD": ("The 3-Clause BSD License", "The 2-Clause BSD License"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License, version 2"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1"),
    "AGPL": ("GNU Affero General Public License, version 3",),
    "MPL": ("Mozilla Public License, version 2.0",),
    "ISC": ("ISC License",),
    "CC-BY": ("Creative Commons Attribution 4.0 International",),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International",),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "Public-Domain": ("CC0 1.0 Universal", "The Unlicense"),
    "Proprietary": ("All rights reserved",),
}

#: Notices that the fit doesn't see: they calibrate its probabilities.
CALIBRATION: dict[str, tuple[str, ...]] = {
    "MIT": ("The source code is available under the MIT license, see the file LICENSE.", "MIT licensed.", "You can use this package under the MIT License."),
    "Apache-2.0": ("This file is distributed under the terms of the Apache License 2.0.", "Apache License, Version 2.0, January 2004", "The library is available under the Apache-2.0 license."),
    "BSD": ("Distributed under the terms of the Modified BSD License.", "The code is available under the 3-clause BSD license.", "This file is covered by a BSD-style license."),
    "GPL": ("The program is distributed under the terms of the GNU General Public License.", "This file is part of a program under the GNU GPL, version 2 or later.", "Covered by the GNU General Public License v3."),
    "LGPL": ("Distributed under the terms of the GNU Lesser General Public License.", "The library is covered by the GNU LGPL, version 2.1 or later.", "LGPL: see the GNU Lesser General Public License for details."),
    "AGPL": ("Distributed under the terms of the GNU Affero General Public License.", "The server is covered by the GNU AGPL, version 3."),
    "MPL": ("This file is available under the Mozilla Public License, version 2.0.", "Covered by the MPL 2.0."),
    "ISC": ("Distributed under the terms of the ISC license.", "ISC licensed, see the file LICENSE."),
    "CC-BY": ("This article is available under the Creative Commons Attribution 4.0 licence.", "Text and figures: CC BY 4.0."),
    "CC-BY-SA": ("Content is available under CC BY-SA 4.0 unless noted.", "Shared under the Creative Commons Attribution-ShareAlike 3.0 licence."),
    "CC-BY-NC": ("The data set is available under CC BY-NC 4.0.", "Shared under the Creative Commons Attribution-NonCommercial licence."),
    "Public-Domain": ("The author has placed this work in the public domain.", "Dedicated to the public domain under CC0 1.0.", "To the public domain: all copyright and related rights are waived."),
    "Proprietary": ("Copyright by the publisher, all rights reserved worldwide.", "Confidential and proprietary information of the company.", "No part of this book may be reproduced without written permission of the publisher."),
}

#: Notices that neither the fit nor its calibration sees: recall is measured on them.
TEST: dict[str, tuple[str, ...]] = {
    "MIT": ("This software is released under the MIT License.", "Licensed under MIT license terms."),
    "Apache-2.0": ("The project is licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."),
    "BSD": ("This project is released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms are permitted provided that the above copyright notice is retained."),
    "GPL": ("You can redistribute this tool under the terms of the GNU General Public License.", "Licensed under the GNU General Public License, version 2."),
    "LGPL": ("This module is free software under the GNU Lesser General Public License.", "Licensed under the GNU Lesser General Public License, version 2.1."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3 or later.", "This service is free software under the GNU Affero General Public License."),
    "MPL": ("Licensed under the Mozilla Public License, v. 2.0.", "This code is subject to the Mozilla Public License."),
    "ISC": ("This project is released under the ISC License.", "Licensed under the ISC License."),
    "CC-BY": ("This report is licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("This page is licensed under CC BY-SA 4.0.", "Available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("This recording is licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Public-Domain": ("This file is released into the public domain.", "Released under the CC0 1.0 Universal dedication."),
    "Proprietary": ("Copyright 2020. All rights reserved.", "This document is confidential and proprietary and may not be disclosed."),
}

#: What a prediction is compared with: the words that name a family, and opening words of its full text. The fit doesn't read them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "License: MIT", "MIT licensed", "Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "this permission notice shall be included in all copies or substantial portions of the Software"),
    "Apache-2.0": ("Apache License", "License: Apache-2.0", "Identifier: Apache", "apache org licenses", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "you may not use this file except in compliance with the License"),
    "BSD": ("BSD license", "BSD-style license", "Clause License", "Clause BSD license", "Identifier: BSD", "Redistribution and use in source and binary forms", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "be used to endorse or promote products derived from this software without specific prior written permission"),
    "GPL": ("GNU General Public License", "GNU GPL", "Identifier: GPL"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "Identifier: LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "Identifier: AGPL"),
    "MPL": ("Mozilla Public License", "the MPL", "Identifier: MPL", "mozilla org MPL"),
    "ISC": ("ISC License", "ISC licensed", "Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA": ("CC BY-SA", "Commons Attribution-ShareAlike"),
    "CC-BY-NC": ("CC BY-NC", "Commons Attribution-NonCommercial"),
    "Public-Domain": ("public domain", "CC0 1.0", "Identifier: Unlicense", "waived all copyright and related or neighboring rights"),
    "Proprietary": ("All rights reserved", "confidential and proprietary", "No part of this publication may be reproduced", "without the prior written permission of the publisher", "without written permission of the publisher"),
}

#: Notices of other licences, which belong to no family. Those at even places calibrate the unknown class, the others test it.
OTHERS: tuple[str, ...] = (
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided 'as-is', without any express or implied warranty, under the zlib licence.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Artistic License 2.0.",
    "Released under the PostgreSQL License.",
    "Licensed under the Open Database License.",
    "Licensed under the Common Development and Distribution License.",
    "Distributed under the Python Software Foundation License.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Microsoft Public License.",
)

#: Ordinary sentences that share words with notices.
PLAIN: tuple[str, ...] = (
    "He lost his driving license after the accident.",
    "The city grants a license to every street vendor.",
    "The general public is invited to the opening on Sunday.",
    "The software was released in the spring and sold well.",
    "Permission to land was granted by the tower.",
    "The author reserves the best rooms for the guests.",
    "This work is hard and the conditions are poor.",
    "All rights of way on the map were checked again.",
    "The university is free of charge for residents.",
    "Version two of the plan was published in the news.",
    "She bought a copy of the book without the cover.",
    "The terms of the agreement were discussed for hours.",
    "Apache helicopters flew over the valley at dawn.",
    "They published the notice in the local paper.",
    "The foundation of the house is made of stone.",
)

#: Ordinary sentences that neither the fit nor its calibration sees.
PLAIN_TEST: tuple[str, ...] = (
    "The license plate of the car was covered with mud.",
    "A copy of the letter was found in the library.",
    "Her rights were read to her in two languages.",
    "The general told the public that the war was over.",
    "Version four of the engine needs less fuel.",
    "The permission slip must be signed by a parent.",
    "Common gulls are common along this coast.",
    "He released the brake and the cart rolled down.",
    "The terms were good and the conditions better.",
    "They reserve a table for two every Friday.",
)
