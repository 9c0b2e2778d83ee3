"""Digests of canonical whole licence texts (see license_scan): licence -> digests, one for each variant.

A variant is a text with or without its title, header or closing instructions, and with or without the line that names its
own holder; how it is wrapped makes no difference. Made from the licence files of a Debian system and of installed packages
whose words equal the public text.
"""

# Fixed values.
WHOLE = {
    "0BSD": """
        25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c
        53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe
        9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153
    """.split(),
    "Apache-2.0": """
        025cf7b7a9bb6836d0ef257c123a98e9abd3fa8ff9507d1fcce6d68607a32a17
        08565266bf770d4ec138a59c181cd46075a48eca66711dd97e8e0786f24bf78a
        0eec64515e7e38084f934776353077fb35c3f1d46d0e18b92a69ce9f6494d1bd
        0fbbbf257fb8f8b08e3fe0b61525f09c27656a29c6a14d10a51b7b70da7cdf10
        1827f75f39f34eb1679997ac2337c60ab8f8618d1229688032ce4e857c269e0f
        1eedbe0001e9dc1800040606668674372f6813381139caae5365be65dcfb2245
        25914244b90a0a8d9e083f27357baf3ed31fe23d03c9e4f8b638742597a3726f
        2fc89832bc599cdecdbc7dd1b9782e32a3312ed4104ac150cf23df20033ba725
        31570c3d1fbd2565a47bdfcbe5aa47853f4a4d3f5c46de992de066d498ce9877
        3265f21c248d6b0cad25100ebb948c3eb88a651619b12cc9b5c10acb966f59f1
        344304e0a7798e1e248e14b43f0d4b2956701558f196ff5b01284bec0b478992
        3db866cd4afc311800cde0e09874e0409a5184944a287bb1d3e321e7b5e84b6b
        404c86ee1e21b585963a09a24030623551fed958baf1c83a20cdab2c402c4ab8
        4086c00725c3053f3d930149fdbd9d6cfefc22c87fcc3fd4de955c308db9ce4a
        4491bd3ebd0c4eb8eb7eae49c90ecbc0b351d4e6b917cd9f254e1c175bc39851
        46c1182146aa21d2f75f782743fa268780565359f030b7f4310d305815f1ebb1
        58564c0bdb0c4d1e4bf8dd25e03045f82b29b678f0935e3d2b33cc1cbffc3ca8
        591853fb32d6f7f99e426034c5203488db670e950055997114e9498339f43583
        5cf9baa8c6c9aae48ed1faae8dc40f433b07ee25c7c8147651f73eda0b6d8643
        62eebac90a99ebe9b65918621fbf89fd5761ece3a6009bd4031fb0bc1e95884b
        7089f88af4453d93877f22cbebe0fd6bcb7689065b125be2aba70a9e4852add9
        7761a709f7fb0bd527bf7a80216f8ea2dd9e9ce5c7b0fa519340786eff65b868
        8a8c76830ac7390fdef875de007dc27580090b94575d3f9e2b63957385b2b32b
        8cae65b0643e953429f3ccbb9b3f224dde805de1f0a793c8a41c27fc1a650b85
        95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184
        9f27b958b24c27a80575949745c6667bb3c301eb49d77c17ba4e300e13682357
        a4c0997584aa6c363c52f67170a85474ae59c6b1de545f24ee10ed494932e4f9
        a8b216be504270c3c8cf4d3d6c6027ffacdafc7dd48ae25b9d6647c17b10bf1e
        aaf00c5ff05abd08c4a565e9da7440ca5cb77c40fd8ba58f93b639c3a5eac45c
        ab294a515448e179ea9bf628820d5db3622662bb88b9919204555f11fd2d3043
        b1d2b4dfab003662e1836a5858bc799b878367797e3acda600aa0221bcacccf8
        b2a66c9ffcbaf32db54d7f630a267ea560dbfc67f84e0da59db2c4bef45bdca6
        b35b83acee1925f4ac31d46b381bc9d2c40dc1a05e2f34d5dabb988b86b42ab6
        be83775e037244ac4a6fc92ca3240f22e10486ffe761bf0bdc1025bd59fd8f4d
        be89523fa5e57bb5af0e34ecec7ada1b16895d72b10384f6fb555421c7042db1
        c48b98294e6f276cc3788dbf602ea5e30d73d969b5191d6b9f4ea5b6c0b53ba9
        c8c1d61893fe269118117851f26d10ecc4931f1d7673e4e2d580818016971c8c
        d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43
        dee4cd49ad25e9850370d106f77a31088c22adc423668af19504220fe5708858
        e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2
        e992d2f01c89f5ff9bd4faa80649dc4d2fffde205c5a6d682cedd15c18490870
        ebe40dc9434bc23af62d751da3f595de94fc7bb7b80e37587d9beeb81152de9f
        ee654ab99d80c75e04e4a020a5ff1fdcdad8e4a8873b7591e6132e73ae04b558
        eef3392d3c9e1b5b629ad6593aa7006e536793663dbf9b05089ddb7adae7b1d6
        f2bd408208f0ff7f37655b529a6c89721404e8c2d2a98baeb4b6adfca477f553
        f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0
        f5e6a8e3318878376a0fb15e2c7396ad50d635742d895cb50c20d1817c7bf6fe
        fb3a809a381cdf54e7205fecb836793c32b7eff3ee8932eebea3c384102a5eef
        ff93e325388a86634261eb580455b3fb6c8b85c829aee58abf916ec0f3c4d6dc
    """.split(),
    "BSD-2-Clause": """
        447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2
        a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30
        f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b
    """.split(),
    "BSD-3-Clause": """
        73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da
        9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2
        cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15
    """.split(),
    "BSL-1.0": """
        4f4c9e65217414246c604405ee4900201bd9f230d226fa803a0b7a1f5775bf85
        5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded
    """.split(),
    "CC-BY-SA-4.0": """
        81b8587922753620501047639c4f7a4fe203a7b1898239c51ad8967471e9916f
        ad6548756654fc6cf98b6cbc2a886a08029b0a8baffa51667bdf5058be65536c
    """.split(),
    "CC0-1.0": """
        96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f
        e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6
    """.split(),
    "GFDL-1.2": """
        292b028a70f5d02d8af35de86bccfece18261230f118b98e599872b0762a48a4
        94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60
    """.split(),
    "GFDL-1.3": """
        9c5ce247c584edabcc67759e6b66e362b9edb8815ce8209f9106e3a0c9a05581
        a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826
    """.split(),
    "GPL-1.0": """
        8a9ccb74f73e459deea9ab73828583de1cd66754c9f8f0699cd2117a96b6b58c
        94f221f7ad43b1b33c3c6730b9c18991dfc0c41e4d85f9f57372df73f1af1453
        e145434be41b70cfaf05be9b52c8a0eae80de1f38ad11600053cc06ce15dc1c9
        ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a
    """.split(),
    "GPL-2.0": """
        1225d02cd36c293fc65ff6aedbed342e33fbb6ff556bc49cb670a60b6992e8c3
        142f86c75ae88179551ad8d5119cd473a778ef0f1f65b03c3ecf92025b3bca2b
        331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6
        6edb7ac52aa23741b1a45887e789d251d854d9d9f38a78ac570cf8f812a37021
    """.split(),
    "GPL-3.0": """
        0472008b2e64866eb1db6471e76fc0cc3cf742180a15ea30a01655e5d9952441
        04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3
        15e592c3d73198c71da816696e6e5947f38a75ecfe2d7bbcefb03831ec147ac5
        2461d3d0f596a2725cfabaa41b961da24609b4d95a683a706bb0d3fa879a7efc
        4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19
        4cc338380bb2967e4d510490b806892d86494ebc89aaf32a6dcbe03d33778e54
        4cce0276d1e2d819f2e1424f32649f534f9e6cc39692bd483fdf1a41e1307999
        4daf25711475345bba3326eb65ac074ad13b96798bf4bd295a284f56837f3ac0
        9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da
        ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636
        eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a
        fc79b587f4a1d5e8d505a3215b6ad3e86560ec9288cb4ba7a7071caca7d815ce
    """.split(),
    "ISC": """
        217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a
        22545e516c83831353f0541d130d7e8581032e9aa39abd000c66edd902324e63
        40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db
        6e9dc1cd727a12354f4cef293d9d285ed81ed312d597842774d1120ac62a6dc6
        94b4e9f723d13830ec6a47b422738caee264943af1673fa32782cefd730ffc82
        e00f31f158e77a60e7375307e014eeb17754967f6d6757d019567221315db4e1
        f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee
    """.split(),
    "LGPL-2.0": """
        504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260
        61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908
        9ccbf81e2fd78db81966e466a22ed39318d0a4b4550cd69d1144dcf09722ff10
        9e78fa98415a9a8c863589ab742457328d22cd2319bbf585de04b27baf33a2be
    """.split(),
    "LGPL-2.1": """
        48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4
        4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891
        52c77b0ef80800dedbe960f4c2357cdf12a08e6fd3749a0436f9cd31b4aeec49
        5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a
        9fadfea1201e84339afda70915d6d7fcc40b7f2795347e87ca66420b4032a473
        a9cc8dda4023821e198a2e1bee36afc3e68fce90828780c7bac37ffe33565e15
        e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9
        f13ce8aa4b0cc0de7c3b73a95e705f217972ef8710e7c0a463342682e2e523de
    """.split(),
    "LGPL-3.0": """
        13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7
        aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be
        ab1202917a49a52eb4671fc091c00933076c119053fff6e8b5849ca93d6b53b3
        ae4df49d9036b60c1389330e0a93571e53b44fdd03bdd79be9aabfda093b4534
    """.split(),
    "MIT": """
        0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c
        266254da18cf53d923f20835662049663f940e8b1a188529befe80078f3bdfe4
        35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164
        5d01a1651a4c284dfbbf1500c7a5c7abb115387c003fbedd1e4624fe9b90b141
        6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f
        6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127
        8e4bbd7a60af408266b0a72be93154a077d00f90eb24f3d44b2a3cb507f37bf2
        94dc2756aa068347d32bc82ecd9f7f309e2a0b433f62b5d2ea960fa9d4ded8fb
        b231082d360c8acd5c69c2395f37e102297f2bf41fed4d545f1cbdcce0317456
        c6ad8e2d3c4b04b0c8e25afb5297d47ee7aa24eb5b7464ad26423d0d8f9a96cc
        d3d2377a4f4929323a897ad4791c8657e5692d49c7fe90e128ddc60854f3d1d2
        e0ec1133ffbb2b3ca539cd8d8bbc6938fd001480f955360a7068e62c83bf1782
        e21b30328b79ff6bb16439758098d08dcced48ec2d46045206a45d273e0e7537
        f5ea3bff2e6ded3fc6d0913d507cf74b87b3cfd78329923e075ba81980803f13
    """.split(),
    "MPL-1.1": """
        34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf
        979f7243204c7078aaa4d4e66ddf86160e3bfb3a2d6271273e461dc82f604699
        a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b
        cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6
    """.split(),
    "MPL-2.0": """
        c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3
        f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a
    """.split(),
    "OFL-1.1": """
        948d415527029259156eea2eaaba34b15d472bf8b2e40c56a8cecf8d7a16786e
        b80f6498cf31cc02c16942b317f9b5b55be820889a29c0a2c97a9e41a7b4eb07
    """.split(),
    "Unlicense": """
        41f84c538b3bc6dcfe6afaab48f6e16c34fd1b11b2c6be7db47873ba3bce291a
        6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf
        7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd
    """.split(),
    "Zlib": """
        1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7
        99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a
        ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145
    """.split(),
}
