"""Licence families: short template sentences, written as the usual notices read."""

FAMILIES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "This file is made available under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPLv3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the GNU LGPL.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0", "Released under the AGPLv3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution licence."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "For non-commercial use only under the Creative Commons Attribution-NonCommercial licence."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}

#: Words from which licence notices of no known family are made for the unknown class.
UNKNOWN_FORMS = [
    "Licensed under the {0} License.", "Released under the {0} {1} Public License, version {2}.", "This work is licensed under the {0} Community Licence.", "SPDX-License-Identifier: LicenseRef-{0}-{1}", "Distributed under the terms of the {0} {1} agreement.",
    "Use of this material is subject to the {0} licence {2}.", "You may use, copy and modify this work under the {0} {1} license terms.", "The {0} licence applies to all files of the {1} package.",
]
ODD = "aurora basalt cinder delta ember falcon granite harbor indigo juniper kestrel lumen meadow nimbus ochre prairie quartz raven sable tundra umber vortex willow zephyr orchid pepper".split()
PLAIN = [
    "The committee met on Tuesday to discuss the new bridge over the river.", "Open the file and read each line into the buffer.", "He was granted a place at the university, free of any charge.", "The general public was invited to the opening.",
    "The version of the story that she told differed from mine.", "Add two cups of flour and stir until smooth.", "All students have the right to appeal.", "The software was slow but worked.", "Please copy the address and send it on.", "Commons and lords debated the act until late.",
]
